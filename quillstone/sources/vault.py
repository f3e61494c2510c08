"""Scans of a vault: captured files, entity pages, the proposal queue, vocabularies, log and assets.

A vault's Markdown is read whole, one file a row; `materialise` turns pages into Parquet once, which
later plans read with pushdown and pruning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import frontmatter
from quillstone.functions.text import content_key
from quillstone.shared import file_system
from quillstone.schemas import CHANNELS, PAGES, SERVICE_DIRS, TYPE_TO_DIR


def _decoded(path) -> F.Column:
    """A URI's path as it is in the file system; a plus sign is one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative(spark: SparkSession, vault: str, path) -> F.Column:
    """A file's URI as a path within the vault."""
    fs, at = file_system(spark, vault)
    root = fs.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    whole = _decoded(path)
    return F.substring(whole, F.instr(whole, root) + len(root), F.length(whole))


def files(spark: SparkSession, vault: str, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, file_name, modified, content) of all files under a folder of the vault; path is relative to the vault, wherever that is."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(f"{vault.rstrip('/')}/{folder}", wholetext=True)
    return rows.select(relative(spark, vault, F.col("_metadata.file_path")).alias("path"), _decoded(F.col("_metadata.file_name")).alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))


def located(rows: DataFrame) -> DataFrame:
    """With raw_class, channel, year and month, as far as the path says: raw/<class>[/<channel>][/YYYY/MM]/."""
    part = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))
    kind = part(r"(?:^|/)raw/([^/]+)/")
    under = part(r"(?:^|/)raw/(?:inbox|quarantine)/(" + "|".join(CHANNELS) + r")/")
    channel = F.coalesce(under, F.when(kind.isin(*CHANNELS), kind))
    return rows.withColumns({"raw_class": kind, "channel": channel, "year": part(r"/(\d{4})/\d{2}/").cast("int"), "month": part(r"/\d{4}/(\d{2})/").cast("int")})


def raw_items(spark: SparkSession, vault: str, raw_class: str | None = None, glob: str = "*.md") -> DataFrame:
    """Captured items with the columns of schemas.RAW_ITEMS; source, channel and captured_at from the frontmatter where it has them."""
    rows = located(files(spark, vault, "raw" + (f"/{raw_class}" if raw_class else ""), glob))
    key = lambda k: F.nullif(F.trim(F.regexp_extract("content", rf"(?s)\A---\n(?:(?!\n---).)*?(?<=\n){k}:[ \t]*([^\n]*)", 1)), F.lit(""))
    fields = {
        "item_key": content_key("content"),
        "source": key("source"),
        "channel": F.coalesce("channel", key("channel")),
        "captured_at": F.coalesce(F.try_to_timestamp(key("captured_at")), "modified"),
        "state": F.when(F.col("raw_class").isin("inbox", "quarantine"), F.col("raw_class")).otherwise("filed"),
    }
    return rows.withColumns(fields).select("item_key", "path", "file_name", "channel", "source", "captured_at", "content", "state", F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("string").alias("was"))


def inbox(spark: SparkSession, vault: str, channel: str | None = None) -> DataFrame:
    return raw_items(spark, vault, "inbox" + (f"/{channel}" if channel else ""))


def quarantine(spark: SparkSession, vault: str) -> DataFrame:
    return raw_items(spark, vault, "quarantine")


def lines(items: DataFrame) -> DataFrame:
    """(path, line, text) of captured items, lines from 1: what citations point at."""
    return items.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """(channel, ts, author, text) of a JSON-lines chat export."""
    return spark.read.schema("channel string, ts timestamp, author string, text string").json(path)


def converted(spark: SparkSession, path: str, convert: Callable[[str, bytes], str], glob: str = "*") -> DataFrame:
    """(path, content): binary documents put through `convert(path, bytes) -> text` on the executors."""
    import pandas as pd

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "content": [convert(p, b) for p, b in zip(part["path"], part["content"], strict=True)]})

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    return rows.mapInPandas(run, "path string, content string")


def html_text(html) -> F.Column:
    """Visible text of a clipped page: no scripts, styles or comments; tags become blanks, entities characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def assets(spark: SparkSession, vault: str) -> DataFrame:
    """(path, modificationTime, length) of the vault's assets; their bytes aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{vault}/raw/assets")
    return rows.select(relative(spark, vault, F.col("path")).alias("path"), "modificationTime", "length")


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path, content) as files under `root`, each whole or not at all, on the executors; returns how many.

    `root` is a folder that all executors share. Doing a part again, as after a lost executor, writes the same files.
    """

    def run(parts):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for part in parts:
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True):
                at = f"{base}/{path}"
                store.create_dir(os.path.dirname(at), recursive=True)
                staged = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}.new"
                with store.open_output_stream(staged) as out:
                    out.write((content or "").encode())
                store.move(staged, at)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], ["n"])

    found = rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()
    return found[0] or 0


def pages(spark: SparkSession, vault: str) -> DataFrame:
    """Entity pages with the columns of schemas.PAGES; a page without a type has its directory's; service directories but the archive are left out."""
    rows = files(spark, vault, "wiki").where(~F.col("path").rlike(r"(?:^|/)wiki/(?:" + "|".join(d for d in SERVICE_DIRS if d != "archive") + ")/"))
    parsed = rows.select("path", "file_name", "content").mapInArrow(frontmatter.parse_pages, PAGES)
    of_dir = F.element_at(F.create_map(*(F.lit(x) for kind, name in TYPE_TO_DIR.items() for x in (name, kind))), F.regexp_extract("path", r"(?:^|/)wiki/([^/]+)/", 1))
    return parsed.withColumn("type", F.coalesce("type", of_dir))


def materialise(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


_EDGE_LINE = r"\(([^()]+)\)\s*--([A-Za-z_]+)-->\s*\(([^()]+)\)(?:.*?conf\s+([0-9.]+))?"


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """The queue of proposed edges: lines `(src) --edge--> (dst) ... conf 0.82`."""
    part = lambda k: F.trim(F.regexp_extract("value", _EDGE_LINE, k))
    conf = F.nullif(part(4), F.lit("")).cast("double")
    return spark.read.text(path).where(F.col("value").rlike(_EDGE_LINE)).select(part(1).alias("src"), part(2).alias("edge"), part(3).alias("dst"), conf.alias("conf"), F.lit("queued").alias("state"))


def graph_schema(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(type), (edge, src_type, dst_type) of a file of CREATE NODE TABLE and CREATE REL TABLE statements."""
    text = spark.read.text(path, wholetext=True)
    found = lambda pattern, k: F.regexp_extract_all("value", F.lit(pattern), F.lit(k))
    node = r"(?i)CREATE\s+NODE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"
    rel = r"(?i)CREATE\s+REL\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\(\s*FROM\s+(\w+)\s+TO\s+(\w+)"
    nodes = text.select(F.explode(found(node, 1)).alias("type"))
    edges = text.select(F.explode(F.arrays_zip(found(rel, 1).alias("edge"), found(rel, 2).alias("src_type"), found(rel, 3).alias("dst_type"))).alias("e")).select("e.*")
    return nodes.select(F.lower("type").alias("type")), edges.select("edge", F.lower("src_type").alias("src_type"), F.lower("dst_type").alias("dst_type"))


def excluded(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose path matches none of the ignore patterns (`*` within a directory, `**` across)."""
    import re

    for p in patterns:
        if p.strip() and not p.startswith("#"):
            regex = "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", p.strip().rstrip("/")))
            rows = rows.where(~F.col("path").rlike(rf"(?:^|/){regex}(?:/|$)"))
    return rows
