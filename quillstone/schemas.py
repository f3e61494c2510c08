"""The data model: tables, closed values and the vocabularies, all of them data that a caller can replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The channels, raw classes and page types with their directories.
CHANNELS = ("journal", "meetings", "emails", "chats", "clippings", "docs")
RAW_CLASSES = ("inbox", "emails", "chats", "meetings", "docs", "clippings", "journal", "assets", "quarantine")
TYPE_TO_DIR = {
    "person": "people",
    "org": "orgs",
    "project": "projects",
    "topic": "topics",
    "decision": "decisions",
    "meeting": "meetings",
    "source": "sources",
    "artifact": "artifacts",
    "thread": "threads",
    "tofile": "tofile",
}
ARCHIVE = "wiki/archive/"
SERVICE_DIRS = ("_inbox", "_maps", "archive", "log-archive")
#: Edge names that are evidenced, with the node types at their ends where those are; a vault's schema replaces them.
EDGE_TYPES = (("works_at", "person", "org"), ("decided", "meeting", "decision"), ("attended", None, None), ("contradicts", None, None), ("superseded_by", None, None))
EDGE_KEYS = tuple(e[0] for e in EDGE_TYPES)

#: The tables, as DDL. A filed item has the batch that filed it and the path that it had in the inbox, a proposal the batch that queued it.
#: A page in the archive has the slug archive/<slug>, where its redirect leads.
RAW_ITEMS = "item_key string, path string, file_name string, channel string, source string, captured_at timestamp, content string, state string, batch_id string, was string"
PAGES = (
    "slug string, type string, path string, file_name string, identity_key string, aliases array<string>, status string, created date, last_verified date, sources array<string>, works_at array<string>, "
    "contradicts array<string>, superseded_by string, rest map<string,string>, body string"
)
EDGES = "src string, edge string, dst string"
PROPOSALS = "src string, edge string, dst string, conf double, state string, batch_id string"
CLAIMS = "subject string, attribute string, value string, valid_from date, source string, recorded_at timestamp, batch_id string"
CHANGES = "batch_id string, path string, op string, before string, after string"
LOG = "ts timestamp, skill string, channel string, op string, path string, batch_id string"


def vocab_nodes(spark: SparkSession, types: dict[str, str] | None = None) -> DataFrame:
    """(type, dir): the closed node vocabulary."""
    return spark.createDataFrame(list((types or TYPE_TO_DIR).items()), "type string, dir string")


def vocab_edges(spark: SparkSession, edges=EDGE_TYPES) -> DataFrame:
    """(edge, src_type, dst_type): the closed edge vocabulary; a null type allows any."""
    return spark.createDataFrame([tuple(e) for e in edges], "edge string, src_type string, dst_type string")
