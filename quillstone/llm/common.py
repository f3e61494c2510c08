"""Shared pieces of the corpus operators: shared-folder tables, Arrow batches as byte arrays, word hashing.

Text columns travel to Python as UTF-8 binaries, so a batch is one byte buffer with offsets and
the word and shingle work is vectorised over the whole buffer.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillstone.shared import stash, unstash  # noqa: F401 - for the operators

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that one vectorised step takes at a time; byte work on a longer document goes in steps of this size.
SLICE_BYTES = 1 << 20
#: Rows that a Parquet scan holds as columns at a time: 4096 texts are one array of tens of MB of an executor's heap, more for long ones.
SCAN_ROWS = 512


def ship(name: str) -> None:
    """Pickle the functions of module `name` by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, and scans' in rows.

    The session's settings are lowered and stay so: they count when a plan runs, which is after an
    operator has returned it.
    """
    for name, most, unit in (("maxRecordsPerBatch", BATCH_ROWS, ""), ("maxBytesPerBatch", BATCH_BYTES, "b")):
        name = f"spark.sql.execution.arrow.{name}"
        if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > most:
            spark.conf.set(name, f"{most}{unit}")
    if int(spark.conf.get(scan := "spark.sql.parquet.columnarReaderBatchSize")) > SCAN_ROWS:
        spark.conf.set(scan, SCAN_ROWS)


def text_bytes(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n (null ids: of the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def buffer_of(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary array without copying; offsets start at 0."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    off = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return data, off - (off[0] if len(off) else 0)


def pieces(column, most: int = SLICE_BYTES):
    """(first row, end, bytes, offsets) of about `most` bytes of a chunked Arrow column at a time, without joining its chunks."""
    row = 0
    for chunk in column.chunks:
        buf, off = buffer_of(chunk)
        for i, j in slices(off, most):
            yield row + i, row + j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        row += len(chunk)


def release() -> None:
    """Give freed memory back to the system, as an idle worker would otherwise keep what a large group took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def frugal(run):
    """A worker's function of batches that gives back what it took, as an idle worker would keep it."""

    def bounded(parts):
        yield from run(parts)
        release()

    return bounded


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (i, j) of documents with about `most` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word index per document (n + 1) of the words [^\\x20\\x09-\\x0D]+."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x *= _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_INK = np.where(_SPACE, np.uint64(0), _BYTE)


def run_hashes(buf: np.ndarray, starts: np.ndarray, value_of: np.ndarray) -> np.ndarray:
    """Sums, over each run from a start to the next, of the bytes' values times powers of their place.

    SLICE_BYTES at a time: a run that goes on in the next step has the power of its place there before its sum.
    """
    out = np.zeros(len(starts), np.uint64)
    n = len(buf)
    for p in range(int(starts[0]) if len(starts) else n, n, SLICE_BYTES):
        q = min(p + SLICE_BYTES, n)
        lo, hi = int(np.searchsorted(starts, p, "right")) - 1, int(np.searchsorted(starts, q))
        heads = starts[lo:hi] - p
        heads[0] = 0
        at = np.arange(q - p, dtype=np.int32)
        at -= np.repeat(heads.astype(np.int32), np.diff(heads, append=q - p))
        value = value_of[buf[p:q]]
        value *= _powers(int(at.max()) + 1)[at]
        sums = np.add.reduceat(value, heads)
        sums[:1] *= np.uint64(pow(_STEP, p - int(starts[lo]), 1 << 64))
        out[lo:hi] += sums
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone; `starts`, `ends` are all words of `buf`."""
    sums = run_hashes(buf, starts, _INK)  # white space adds nothing to the word before it
    return mix(sums + (ends - starts).astype(np.uint64)) if len(sums) else sums


_PLACE = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words in `words`, in order (document borders are the caller's)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACE[0]
    for i in range(1, width):
        out += words[i : i + n] * _PLACE[i]
    return mix(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence (under 60 words); differs from any shingle's by its length."""
    return mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(words) * 0x5851F42D4C957F2D % 2**64))[0]


ship(__name__)
