"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage works on all rows that the one before kept, and every stage but the last returns the
columns of `documents`. `run` writes each stage's result as Parquet into the shared folder and reads it
again as the next stage's documents.

Defined cases, for every stage: an empty table gives an empty one; columns that a stage doesn't know, of whatever name,
pass through it up to packing, which gives pieces; nulls may be in any column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, neardup, packing, pii, toxicity
from quillstone.llm.common import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model scores below 0.7.

    Null, empty and wordless texts have the score of no words; rows that repeat go or stay alike. With labels of
    one class only all rows have one score, the share of label 1, and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels, threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (shingles of five words, similarity 0.8): that of the smallest doc_id.

    Rows without words are no copies of each other and stay, but for repeats of an id; a group without any id keeps one row.
    """
    return neardup.keep_one(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark. Null and empty texts stay, as does everything if there are no items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind, and n_chars of the new text (null texts stay null, and so does their n_chars)."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that the rows' tokens are packed into. A null or empty text is its closing id alone, a null source a queue of its own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal),
    ("packing", pack_tokens),
]

#: Trained models and tokenizers: no stage but the masking's filter could be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
