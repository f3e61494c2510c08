"""Incremental inbox, an addition: the reference knows only batch runs.

New files are read once each, deduplicated by content key against what is stored, and appended; a run
takes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import content_key
from quillstone.operators.ingest import keep_first, unseen


def ingest_available(spark: SparkSession, inbox: str, table: str, checkpoint: str, glob: str = "*.md") -> None:
    """Append the inbox's new files (path, item_key, content) to the Parquet table; safe to run again."""
    rows = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("wholetext", True).format("text").load(inbox)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).withColumn("item_key", content_key("content"))

    def store(batch: DataFrame, epoch: int) -> None:
        new = keep_first(batch, "item_key", "path")
        at = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(table)
        if at.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(at):
            new = unseen(new, batch.sparkSession.read.parquet(table))
        new.write.mode("append").parquet(table)

    rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def events_per_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per event type and window of a stream or table with ts, event_type and value; late rows beyond the watermark are dropped from streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
