"""Undoing a batch that later batches built on."""

import datetime

import pytest

from quillstone.functions import frontmatter
from quillstone.operators import ingest
from quillstone.vault import Vault

from .test_vault import rows

AT = datetime.datetime(2026, 5, 25)


@pytest.fixture
def box(spark, tmp_path):
    v = Vault(spark, f"file://{tmp_path}/vault")
    v.init()
    page = "---\ntype: topic\n---\nAbout it.\n"
    v._save("pages", v._pages_of(spark.createDataFrame([("wiki/topics/it.md", page), ("wiki/topics/other.md", page)], "path string, content string")))
    return v


def told(spark, box, name, text, batch):
    box.collect(spark.createDataFrame([(name, "journal", "s", AT, text)], "file_name string, channel string, source string, captured_at timestamp, content string"))
    box.ingest(batch, approve=True)


def test_what_later_batches_did_stays(spark, box):
    told(spark, box, "a.md", "about [[it]] and [[other]]", "b1")
    told(spark, box, "b.md", "more about [[it]]", "b2")
    assert rows(box.undo_plan("b1"), "path", "op", "conflict") == [("wiki/topics/it.md", "update", None), ("wiki/topics/other.md", "update", None)]
    box.undo_ingest("b1")
    pages = {r["slug"]: r for r in box.table("pages").collect()}
    assert "mentioned in b.md" in pages["it"]["body"] and "a.md" not in pages["it"]["body"]
    assert pages["it"]["sources"] == ["raw/journal/2026/05/b.md"] and pages["other"]["body"] == "About it.\n" and pages["other"]["sources"] is None
    box.undo_ingest("b2")  # and in this order too
    assert box.table("pages").where("slug = 'it'").first()["sources"] is None
    assert rows(box.table("inbox"), "file_name") == [("a.md",), ("b.md",)]


def test_conflicts_are_rows_and_nothing_is_undone(spark, box):
    told(spark, box, "a.md", "about [[fresh]]", "b1")
    told(spark, box, "b.md", "more about [[fresh]]", "b2")
    told(spark, box, "c.md", "only [[it]]", "b3")
    plan = box.undo_plan("b1").collect()
    assert [(r["path"], r["conflict"]) for r in plan] == [("wiki/tofile/fresh.md", "created by the batch, then changed by b2")]
    assert rows(ingest.dependents(box.table("changes"), "b1"), "batch_id") == [("b2",)]
    before = box._store.latest()
    with pytest.raises(ValueError, match="undo_plan"):
        box.undo_ingest("b1")
    assert box._store.latest() == before
    box.undo_ingest("b2")
    box.undo_ingest("b1")
    assert box.table("pages").where("slug = 'fresh'").count() == 0


def test_dependents_go_on(spark):
    changes = spark.createDataFrame([("b1", "p", "create"), ("b2", "p", "update"), ("b2", "q", "create"), ("b3", "q", "delete"), ("b4", "r", "update"), ("b3", "p", "update")], "batch_id string, path string, op string")
    assert rows(ingest.dependents(changes, "b1"), "batch_id") == [("b2",), ("b3",)]
    assert rows(ingest.dependents(changes, "b4"), "batch_id") == []


@pytest.mark.parametrize(
    ("was", "now", "back", "want", "conflicts"),
    [
        ("status: b", "status: b", "status: a", "status: a", []),
        ("status: b", "status: c", "status: a", "status: c", ["status: c"]),
        ("sources: [x]", "sources: [x, y]", "type: topic", "sources: [y]", []),
        ("sources: [x, y]", "sources: [y, z]", "sources: [y]", "sources: [y, z]", []),
        ("k: 1\nn: 2", "k: 1\nn: 3", "n: 2", "n: 3", []),
        ("a: [", "a: [\nb: 1", "a: [", "a: [\nb: 1", []),
    ],
)
def test_keys_are_taken_back_one_by_one(was, now, back, want, conflicts):
    page = lambda block: f"---\n{block}\n---\nbody\n"
    text, lost = frontmatter.taken_back("wiki/a.md", page(was), page(now), page(back))
    parsed = lambda x: frontmatter.page_of("wiki/a.md", "a.md", x)
    assert parsed(text) | {"type": None} == parsed(page(want)) | {"type": None} and lost == conflicts
