"""The commands on a vault of tables, from taking over Markdown files to undoing an ingest."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.vault import Vault

from .test_vault import root, rows  # noqa: F401 - the Markdown vault is a fixture there

ITEMS = "file_name string, channel string, source string, captured_at timestamp, content string"
AT = datetime.datetime(2026, 5, 25)


@pytest.fixture
def box(spark, root, tmp_path):  # noqa: F811
    v = Vault(spark, f"file://{tmp_path}/vault")
    v.init()
    v.load(root)
    return v


def test_init_refuses_a_vault(box):
    with pytest.raises(FileExistsError):
        box.init()


def test_daily_loop(spark, box):
    items = spark.createDataFrame([("x.md", "meetings", "mic", AT, "Cora Lind works at Alder. See [[fresh-topic]]."), ("y.md", "emails", "m", AT, "plain mail\n"), ("z.md", "emails", "m", AT, "  ")], ITEMS)
    assert rows(box.collect(items), "channel", "new", "duplicates") == [("emails", 1, 1), ("meetings", 1, 0)]
    assert rows(box.collect(items), "channel", "new") == [("emails", 0), ("meetings", 0)]
    pages, raw = rows(box.table("pages"), "path", "body"), rows(box.table("raw"), "path", "state")
    diff = box.ingest("b1")
    assert rows(box.table("pages"), "path", "body") == pages  # nothing is written without approval
    assert any("+- mentioned in x.md" in r["diff"] for r in diff.collect())
    box.ingest("b1", approve=True)
    after = {r["slug"]: r for r in box.table("pages").collect()}
    assert "- mentioned in x.md" in after["cora-lind"]["body"] and "raw/meetings/2026/05/x.md" in after["cora-lind"]["sources"]
    assert after["fresh-topic"]["type"] == "tofile" and after["fresh-topic"]["path"] == "wiki/tofile/fresh-topic.md"
    states = dict(rows(box.table("raw").select("file_name", "state"), "file_name", "state"))
    assert states["x.md"] == "filed" and states["z.md"] == "quarantine"
    assert box.table("proposals").where("src = 'cora-lind' and conf = 0.6").count() == 1
    assert box.ingest("b2", approve=True).count() == 0
    assert rows(box.status("2026-05-02")["last_ingest"], "channel") == [("emails",), ("meetings",)]
    box.undo_ingest("b1")
    again = {r[0]: r[1] for r in rows(box.table("pages"), "path", "body")}
    assert again == dict(pages)
    assert {p for p, s in rows(box.table("raw"), "path", "state") if s == "inbox"} == {p for p, s in raw if s == "inbox"} - {"raw/inbox/emails/z.md"}


def test_promotion(spark, box):
    decisions = box.table("proposals").select("src", "edge", "dst", F.when(F.col("conf") < 0.5, "confirm").otherwise("skip").alias("decision")).where("edge = 'works_at'")
    box.promote(decisions)
    assert box.table("edges").where("src = 'selma' and edge = 'works_at' and dst = 'alder'").count() == 1
    assert rows(box.table("proposals"), "src") == [("plan-review",)]
    decide = lambda d: box.promote(spark.createDataFrame([("plan-review", "decided", "size-999", d)], "src string, edge string, dst string, decision string"))
    decide("confirm")
    assert box.table("proposals").count() == 1  # there is no such page yet
    decide("skip")
    assert box.table("proposals").count() == 0
    assert ("cora-lind", 2) in rows(box.neighbours("selma", 2), "id", "hop")
    assert box.validate().where("rule = 'wrong_end'").count() == 1 and box.canvas().count() > 0


def test_undo_leaves_other_batches_alone(spark, box):
    item = lambda channel, text: spark.createDataFrame([("notes.md", channel, "s", AT, text)], ITEMS)
    box.collect(item("journal", "one about [[topic-a]]"))
    box.ingest("b1", approve=True)
    box.collect(item("emails", "two about [[topic-b]]"))
    box.ingest("b2", approve=True)
    before = rows(box.table("filed").where("batch_id = 'b1'"), "path", "was", "state")
    box.undo_ingest("b2")
    assert rows(box.table("filed").where("batch_id = 'b1'"), "path", "was", "state") == before
    assert ("raw/journal/2026/05/notes.md", "raw/inbox/journal/notes.md", "filed") in before
    assert rows(box.table("inbox"), "path", "state") == [("raw/inbox/emails/notes.md", "inbox")]
    slugs = {r["slug"] for r in box.table("pages").collect()}
    assert "topic-a" in slugs and "topic-b" not in slugs
    # A page that a later batch changed isn't put back to before it.
    box.collect(item("chats", "three about [[topic-a]]"))
    box.ingest("b3", approve=True)
    with pytest.raises(ValueError):
        box.undo_ingest("b1")
    box.undo_ingest("b3")
    box.undo_ingest("b1")
    assert "topic-a" not in {r["slug"] for r in box.table("pages").collect()}


def test_promotion_keeps_every_target(spark, box):
    queue = [("plan-review", "decided", "size-999"), ("plan-review", "decided", "size-9995"), ("alder", "attended", "board"), ("size-999", "superseded_by", "size-9995"), ("selma", "works_at", "alder"), ("nobody", "works_at", "alder")]
    box._save("pages", box.table("pages").unionByName(box.table("pages").where("slug = 'plain'").withColumns({"slug": F.lit("plan-review"), "path": F.lit("wiki/meetings/plan-review.md"), "type": F.lit("meeting")})))
    box._save("proposals", spark.createDataFrame([(*q, 0.5, "queued") for q in queue], "src string, edge string, dst string, conf double, state string"))
    box.promote(box.table("proposals").withColumn("decision", F.lit("confirm")))
    assert rows(box.table("proposals"), "src") == [("nobody",)]
    edges = rows(box.table("edges"), "src", "edge", "dst")
    assert set(queue[:-1]) <= set(edges) and ("alder", "attended", "plan-review") in edges
    assert box.table("pages").where("slug = 'size-999'").first()["superseded_by"] == "size-9995"
    # Through Markdown and back the lists are the same.
    again = box._pages_of(box.harmonised())
    assert rows(again, "slug", "superseded_by") == rows(box.table("pages"), "slug", "superseded_by")
    from quillstone.operators import graph

    assert rows(graph.project(again)[1], "src", "edge", "dst") == edges


def test_a_command_that_fails_changes_nothing(spark, box, monkeypatch):
    from quillstone.store import Conflict

    box.collect(spark.createDataFrame([("x.md", "meetings", "mic", AT, "about [[fresh]]")], ITEMS))
    before = box._store.latest()
    monkeypatch.setattr(box, "project", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        box.ingest("b1", approve=True)
    monkeypatch.undo()
    assert box._store.latest() == before and box.table("changes").count() == 0
    # Somebody else's change in between refuses this one, and the vault is as they left it.
    other = Vault(spark, box.base)
    monkeypatch.setattr(box, "project", lambda: other.rename("alder", "oak"))
    with pytest.raises(Conflict):
        box.ingest("b1", approve=True)
    monkeypatch.undo()
    assert box.table("inbox").count() == 3 and box.table("pages").where("slug = 'oak'").count() == 1


def test_log(spark, box):
    box.collect(spark.createDataFrame([("x.md", "meetings", "mic", AT, "text")], ITEMS))
    n = box.table("log").count()
    box.ingest("b1", approve=True)
    assert len(box._parts("log")) == 3 and box.table("log").count() > n  # the empty one, and one of each command
    box.archive_log("2999-01-01")
    assert box.table("log").count() == 0 and box.table("log_archive").count() > n
    assert box.vacuum(1) > 0 and box.table("log_archive").count() > n


def test_questions_and_health(spark, box, tmp_path):
    assert box.query("what about the energy plan?").count() > 0
    at = box._store.latest()[0]
    assert box.query("what about the energy plan?").count() > 0 and box._store.latest()[0] == at  # the index is there
    assert box.thread("energy plan").count() == 2
    assert box.write_thread("energy plan", "t1", approve=True).count() == 1 and box.table("pages").where("path = 'wiki/threads/energy-plan.md' and type = 'thread'").count() == 1
    assert box.write_thread("energy plan", "t2", approve=True).count() == 0 and box.write_thread("no such thing", "t3").count() == 0
    assert "## Lint debt" in box.overview("2026-05-02")
    assert ("wiki/_maps/people.md", "- [[dan]]") in rows(box.maps(), "path", "text")
    assert rows(box.match("(person)-[works_at]->(org)"), "n0", "n1") == [("cora-lind", "alder")]
    pages = box.table("pages").count()
    changes = box.refactor(30, "r1", approve=True)
    assert {r["op"] for r in changes.collect()} == {"create", "update"} and box.table("pages").count() > pages
    assert "- [[cora-lind-mentions]]" in box.table("pages").where("slug = 'cora-lind'").first()["body"] and box.table("pages").where("slug = 'cora-lind-mentions'").first()["body"] == "- first"
    assert box.export(f"file://{tmp_path}/out") == box.table("pages").count() and (tmp_path / "out/wiki/people/dan.md").exists()


def test_upkeep(spark, box):
    before = box.table("edges").count()
    box.rename("alder", "alder-corp")
    assert box.table("edges").count() == before and box.table("edges").where("dst = 'alder-corp'").count() == 1
    assert box.table("pages").where("path = 'wiki/orgs/alder-corp.md' and body like '%[[alder-corp]]%'").count() == 1
    assert rows(box.archive("2026-05-02"), "from_slug") == [("selma",)]
    assert box.table("pages").where("path = 'wiki/archive/selma.md'").count() == 1
    assert box.archive("2026-05-02").count() == 0
    two = box.table("pages").withColumn("identity_key", F.when(F.col("slug").isin("dan", "cora-lind"), "same"))
    box._save("pages", two)
    assert rows(box.merge(), "keeper", "n") == [("cora-lind", 2)]
    assert box.table("pages").where("slug = 'dan'").count() == 0 and ("dan", "cora-lind") in rows(box.table("redirects"), "from_slug", "to_slug")
    assert box.compile(spark.createDataFrame([("raw/meetings/2026/05/q2.md",)], "path string"), "c1").count() == 1
    before = box.table("changes").count()
    box.compile(spark.createDataFrame([("raw/meetings/2026/05/q2.md",)], "path string"), "c1", approve=True)
    assert box.table("changes").count() == before + 1
    assert box.link().count() == 0
