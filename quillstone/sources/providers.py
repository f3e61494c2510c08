"""Provider connectors as a Python data source: exports that a provider drops as JSON lines.

spark.dataSource.register(ExportSource); spark.read.format("provider_export").option("path", ...).load(), or readStream
to get only what is new: its offset is how many bytes of each file were taken.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = ("channel", "source", "captured_at", "title", "content")
SPLIT_BYTES = 64 << 20


class ExportSource(DataSource):
    """Rows of *.jsonl files (or those of option suffix) in a folder that all executors share, by path or URI; a partition for every SPLIT_BYTES."""

    @classmethod
    def name(cls) -> str:
        return "provider_export"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def _given(self) -> tuple[str, int, str]:
        return self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))), self.options.get("suffix", ".jsonl")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._given())


def _open(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _listed(path: str, suffix: str) -> dict[str, int]:
    """Path -> size of the export files in a folder."""
    from pyarrow import fs

    store, base = _open(path)
    return {f.path: f.size for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))}


def _lines(at: str, path: str, begin: int, end: int):
    """(offset, line) of a file's lines that begin in the bytes from `begin` to `end`."""
    import io

    store, _ = _open(at)
    with store.open_input_file(path) as raw:
        raw.seek(max(begin - 1, 0))
        lines, place = io.BufferedReader(raw), max(begin - 1, 0)
        if begin:
            place += len(lines.readline())
        while place < end:
            line = lines.readline()
            if not line:
                return
            if line.strip():
                yield place, line
            place += len(line)


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, suffix: str):
        self.path, self.split, self.suffix = path, split, suffix

    def partitions(self):
        parts = [InputPartition((p, at, min(at + self.split, size))) for p, size in sorted(_listed(self.path, self.suffix).items()) for at in range(0, size, self.split)]
        return parts or [InputPartition(None)]

    def read(self, partition):
        """The lines that begin in the partition's bytes."""
        if partition.value is None:
            return
        for _, line in _lines(self.path, *partition.value):
            row = json.loads(line)
            yield tuple(row.get(c) for c in COLUMNS)


BLOCK = 1 << 16


class _Stream(DataSourceStreamReader):
    """What was appended to exports, or came as new files, since the offset {path: bytes taken} that the query committed.

    A line is taken once its end is written. A file that got shorter was written anew and is read from its start; one that
    is gone is forgotten. A line that is no JSON object comes as a row of channel 'quarantine', so that it can't hold up the rest.
    """

    def __init__(self, path: str, split: int, suffix: str):
        self.path, self.split, self.suffix = path, split, suffix
        self._whole: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: self._ended(p, size) for p, size in sorted(_listed(self.path, self.suffix).items())}

    def _ended(self, path: str, size: int) -> int:
        """Bytes of a file up to its last line's end; remembered for files that haven't grown."""
        known, taken = self._whole.get(path, (-1, 0))
        if known != size:
            store, _ = _open(self.path)
            taken = 0
            with store.open_input_file(path) as raw:
                for at in range((size - 1) // BLOCK * BLOCK, -1, -BLOCK):
                    raw.seek(at)
                    found = raw.read(min(BLOCK, size - at)).rfind(b"\n")
                    if found >= 0:
                        taken = at + found + 1
                        break
            self._whole[path] = size, taken
        return taken

    def partitions(self, start: dict, end: dict):
        parts = []
        for path, to in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if begin > to else begin
            parts += [InputPartition((path, at, min(at + self.split, to))) for at in range(begin, to, self.split)]
        return parts or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        for _, line in _lines(self.path, *partition.value):
            try:
                row = json.loads(line)
                row = {c: row.get(c) if isinstance(row.get(c), str | None) else json.dumps(row[c]) for c in COLUMNS}
            except (ValueError, AttributeError):
                row = {"channel": "quarantine", "content": line.decode("utf-8", "replace").rstrip("\r\n")}
            yield tuple(row.get(c) for c in COLUMNS)
