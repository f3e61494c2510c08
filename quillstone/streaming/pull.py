"""Pulling provider exports: only what is new since the last run, each item once, duplicates counted however late they come.

The query's checkpoint holds how far each export was read and, per item, how often it came; a run takes what is there and
stops. One that is stopped anywhere goes on from the last batch that was committed, and its output counts a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions.text import content_key
from quillstone.shared import file_system
from quillstone.sources.providers import COLUMNS, ExportSource

_ORDER = ["captured_at", "channel", "source", "title"]
_ROW = "item_key string, " + ", ".join(f"{c} string" for c in COLUMNS)
#: One row per item and batch: whether this batch brought the item, and how many duplicates of it.
PULLED = _ROW + ", taken boolean, duplicates long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each item in an Arrow batch and how many it has, so that an item copied often is few rows when shuffled."""
    for rows in batches:
        rows = rows.sort_values(["item_key", *_ORDER], na_position="first", kind="stable")
        n = rows.groupby("item_key")["item_key"].transform("size")
        yield rows.assign(n=n).drop_duplicates("item_key")


class _Once(StatefulProcessor):
    """Per item, the number of its rows so far; a batch gives the least of its rows if the item is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        before = self._seen.get()[0] if self._seen.exists() else 0
        least, n = None, 0
        for r in rows:
            n += r["n"]
            order = [(r[c] is not None, r[c] or "") for c in _ORDER]
            if least is None or order < least[0]:
                least = order, r
        self._seen.update((before + n,))
        given = [least[1][c] if not before else None for c in COLUMNS]
        yield Row(item_key=key[0], **dict(zip(COLUMNS, given, strict=True)), taken=not before, duplicates=n - (not before))

    def close(self) -> None:
        pass


def _stopped(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the last run planned a batch that it didn't commit."""
    fs, _ = file_system(spark, checkpoint)
    last = []
    for log in ("offsets", "commits"):
        at = file_system(spark, f"{checkpoint}/{log}")[1]
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        last.append(max((int(n) for n in names if n.isdigit()), default=-1))
    return last[0] > last[1]


def pull(spark: SparkSession, exports: str, table: str, checkpoint: str, suffix: str = ".jsonl") -> None:
    """Append what came to `exports` since the last pull to the Parquet table (PULLED); safe to stop and to run again.

    An item is known by its content (null counts as empty). The rows of one that came before only count its duplicates. The state
    grows with the items, in RocksDB and on the checkpoint's file system; exports, table and checkpoint have to be shared.
    """
    spark.dataSource.register(ExportSource)
    rows = spark.readStream.format(ExportSource.name()).option("path", exports).option("suffix", suffix).load()
    rows = rows.select(content_key(F.coalesce("content", F.lit(""))).alias("item_key"), *COLUMNS)
    folded = rows.mapInPandas(_folded, _ROW + ", n long")
    items = folded.groupBy("item_key").transformWithState(statefulProcessor=_Once(), outputStructType=PULLED, outputMode="Append", timeMode="None")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the setting it started with
    try:
        for _ in range(1 + _stopped(spark, checkpoint)):  # a run that has a batch to finish does only that
            items.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def pulled(spark: SparkSession, table: str) -> DataFrame:
    """Each item of a pulled table once (item_key and the export's columns), with its duplicates of all runs."""
    rows = spark.read.schema(PULLED).parquet(table)
    taken = rows.where("taken").drop("taken", "duplicates")
    counts = rows.groupBy("item_key").agg(F.sum("duplicates").alias("duplicates"))
    return taken.join(counts, "item_key")
