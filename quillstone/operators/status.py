"""Dashboard figures and the overview page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inbox_depth(items: DataFrame, by: str = "channel", key: str = "item_key") -> DataFrame:
    """Items per channel and the largest key; one partial aggregate, no sort."""
    return items.groupBy(by).agg(F.count("*").alias("depth"), F.max(key).alias("last_id"))


def last_ingest(log: DataFrame, by: str = "channel", at: str = "ts") -> DataFrame:
    return log.groupBy(by).agg(F.max(at).alias("last_ts"), F.count("*").alias("n"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("type").agg(F.count("*").alias("n"))


def log_size(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries"))


def overview(counts: DataFrame, debt: DataFrame) -> str:
    """The overview page as Markdown; both inputs have one row per closed value."""
    table = lambda title, df: [f"## {title}", "", *(f"- {a}: {b}" for a, b in sorted((str(r[0]), r[1]) for r in df.collect())), ""]
    return "\n".join(["# Overview", "", *table("Pages", counts), *table("Lint debt", debt)])
