"""That no command loses what a user wrote: names that clash, blocks that are no YAML, renames, merges, the archive and undo."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import frontmatter
from quillstone.functions.text import append_bullet, append_bullets
from quillstone.vault import Vault

from .test_vault import rows

AT = datetime.datetime(2026, 5, 25)
ITEMS = "file_name string, channel string, source string, captured_at timestamp, content string"


@pytest.fixture
def box(spark, tmp_path):
    v = Vault(spark, f"file://{tmp_path}/vault")
    v.init()
    return v


def items(spark, *rows_):
    return spark.createDataFrame([(name, channel, "s", AT, text) for name, channel, text in rows_], ITEMS)


def put(box, *files):
    """Pages from (path, content)."""
    box._save("pages", box._pages_of(box.spark.createDataFrame(files, "path string, content string")))
    box.project()


def page(box, slug):
    return box.table("pages").where(F.col("slug") == slug).first()


def test_files_of_one_name_are_kept_apart(spark, box):
    report = box.collect(items(spark, ("day.md", "journal", "one"), ("day.md", "journal", "two"), ("day.md", "emails", "three"), ("copy.md", "journal", "one")))
    assert rows(report, "channel", "new", "duplicates") == [("emails", 1, 0), ("journal", 2, 1)]
    assert rows(box.collect(items(spark, ("day.md", "journal", "four"), ("no-end", "journal", "five"))), "new") == [(2,)]
    box.ingest("b1", approve=True)
    box.collect(items(spark, ("day.md", "journal", "six"), ("no-end", "journal", "seven")))
    box.ingest("b2", approve=True)
    raw = box.table("raw")
    assert raw.count() == 7 and raw.select("path").distinct().count() == 7
    assert sorted(r["content"] for r in raw.collect()) == sorted(["one", "two", "three", "four", "five", "six", "seven"])


def test_a_block_that_is_no_yaml_is_written_back(spark, box):
    odd = "---\nkey: [unclosed\nother: : x\n---\nbody\n"
    nested = "---\ntype: topic\nmap:\n  a: {b: 1}\n  c: [2, 3]\nrows:\n  - {x: 1}\n  - y\n---\nbody\n"
    put(box, ("wiki/topics/odd.md", odd), ("wiki/topics/nested.md", nested))
    out = dict(rows(box.harmonised(), "path", "content"))
    assert out["wiki/topics/odd.md"] == odd
    again = {r["slug"]: r for r in box._pages_of(box.harmonised()).collect()}
    assert again["nested"]["rest"] == page(box, "nested")["rest"] == {"map": '{"a": {"b": "1"}, "c": ["2", "3"]}', "rows": '[{"x": "1"}, "y"]'}
    assert "map: {" in out["wiki/topics/nested.md"]
    box.collect(items(spark, ("n.md", "journal", "about [[odd]]")))
    box.ingest("b1", approve=True)
    out = dict(rows(box.harmonised(), "path", "content"))["wiki/topics/odd.md"]
    assert out.startswith("---\nkey: [unclosed\nother: : x\n---\nbody\n") and "- mentioned in n.md" in out


def test_rename_reaches_every_place(spark, box):
    put(
        box,
        ("wiki/people/ann.md", "---\ntype: person\nworks_at: [org]\n---\n"),
        ("wiki/orgs/org.md", "---\ntype: org\n---\nRun by [[ann|Ann]] and [[ann#x]], not [[annabel]].\n"),
        ("wiki/meetings/m.md", "---\ntype: meeting\nattended: [ann, bob]\ndecided: ann\nnote: ann\n---\n"),
    )
    edges = box.table("edges").count()
    with pytest.raises(ValueError, match="already"):
        box.rename("ann", "org")
    with pytest.raises(ValueError, match="no page"):
        box.rename("nobody", "x")
    plan = box.rename("ann", "anna", approve=False)
    assert rows(plan, "op", "path") == [("create", "wiki/people/anna.md"), ("delete", "wiki/people/ann.md"), ("update", "wiki/meetings/m.md"), ("update", "wiki/orgs/org.md")]
    assert page(box, "ann") and box.table("changes").count() == 0
    box.rename("ann", "anna", batch_id="r1")
    assert box.table("edges").count() == edges and box.table("edges").where("'ann' in (src, dst)").count() == 0
    assert page(box, "m")["rest"] == {"attended": '["anna","bob"]', "decided": "anna", "note": "ann"}
    assert page(box, "org")["body"] == "Run by [[anna|Ann]] and [[anna#x]], not [[annabel]].\n"
    assert rows(box.table("redirects"), "from_slug", "to_slug") == [("ann", "anna")]
    assert box.table("changes").where("batch_id = 'r1'").count() == 4 and box.table("log").where("skill = 'rename'").count() == 4
    box.rename("anna", "ann")
    assert rows(box.table("redirects"), "from_slug", "to_slug") == [("anna", "ann")]


def test_merge_leaves_nothing_dangling(spark, box):
    put(
        box,
        ("wiki/people/ann.md", "---\ntype: person\nidentity_key: k\naliases: [A]\n---\nOne.\n"),
        ("wiki/people/ann2.md", "---\ntype: person\nidentity_key: k\naliases: [B]\n---\nTwo.\n"),
        ("wiki/people/z.md", "---\ntype: person\nworks_at: [ann, ann2]\nattended: [ann2]\nsuperseded_by: ann2\n---\nSee [[ann2]].\n"),
    )
    box._save("proposals", spark.createDataFrame([("z", "works_at", "ann2", 0.5, "queued")], "src string, edge string, dst string, conf double, state string"))
    assert box.merge(approve=False).count() == 3 and page(box, "ann2")
    assert rows(box.merge(), "keeper", "n") == [("ann", 2)]
    z = page(box, "z")
    assert (z["works_at"], z["superseded_by"], z["rest"], z["body"]) == (["ann"], "ann", {"attended": '["ann"]'}, "See [[ann]].\n")
    assert page(box, "ann")["body"] == "One.\n\n\nTwo.\n" and page(box, "ann")["aliases"] == ["A", "B"]
    assert rows(box.table("proposals"), "dst") == [("ann",)] and rows(box.table("redirects"), "from_slug", "to_slug") == [("ann2", "ann")]
    assert box.lint("2026-01-01").where("rule = 'dangling_link'").count() == 0
    assert box.merge().count() == 0


def test_the_archive_is_out_of_the_way_but_kept(spark, box, tmp_path):
    put(box, ("wiki/topics/old.md", "---\ntype: topic\nlast_verified: 2020-01-01\n---\nancient words\n"), ("wiki/topics/new.md", "---\ntype: topic\nlast_verified: 2026-01-01\n---\nancient too, like [[old]]\n"))
    assert box.archive("2026-01-02", approve=False).count() == 2 and box.table("redirects").count() == 0
    assert rows(box.archive("2026-01-02"), "from_slug", "to_slug") == [("old", "archive/old")]
    assert page(box, "archive/old")["path"] == "wiki/archive/old.md"
    assert box.table("nodes").where("id like '%old'").count() == 0
    assert box.lint("2026-01-02").where("rule in ('stale', 'orphan') and slug like '%old'").count() == 0
    assert rows(box.query("ancient words?").select("path").distinct(), "path") == [("wiki/topics/new.md",)]
    assert box.archive("2026-01-02").count() == 0
    # Written out and taken over again, the archive is still there.
    box.export(f"file://{tmp_path}/out")
    (tmp_path / "out/raw/inbox/journal").mkdir(parents=True)
    (tmp_path / "out/raw/inbox/journal/x.md").write_text("x")
    other = Vault(spark, f"file://{tmp_path}/other")
    other.init()
    other.load(f"{tmp_path}/out")
    assert rows(other.table("pages"), "slug") == [("archive/old",), ("new",)] and other.live().count() == 1


def test_undo_takes_back_proposals(spark, box):
    box.collect(items(spark, ("a.md", "journal", "Cora Lind works at Alder. (x) --attended--> (y)")))
    box.ingest("b1", approve=True)
    box.collect(items(spark, ("b.md", "journal", "Cora Lind works at Alder. Dan Ode works at Alder.")))
    box.ingest("b2", approve=True)
    assert rows(box.table("proposals"), "src", "batch_id") == [("cora-lind", "b1"), ("dan-ode", "b2"), ("x", "b1")]
    box.undo_ingest("b1")
    assert rows(box.table("proposals"), "src", "batch_id") == [("cora-lind", None), ("dan-ode", "b2")]  # b.md says so too
    box.undo_ingest("b2")
    assert box.table("proposals").count() == 1  # of no batch any more, so for a reviewer to skip


def test_bullets_at_once_are_bullets_one_by_one(spark):
    bodies = ["", "text", "## Mentions\n- old\n\n## Other\n- b1\n", "x\n## Mentions", "## Mentions\n- b2\n# End"]
    df = spark.createDataFrame([(b, ["b1", "b2", "b1", "b3"][:n]) for b in bodies for n in range(5)], "body string, bullets array<string>")
    one = F.aggregate("bullets", F.col("body"), lambda b, x: append_bullet(b, F.lit("Mentions"), x))
    for r in df.select(one.alias("one"), append_bullets("body", F.lit("Mentions"), F.col("bullets")).alias("all")).collect():
        assert r["one"] == r["all"]


@pytest.mark.parametrize("block", ["a: 1", "a:\n  - x\n  - y", "a: {b: c}", "a: 'it''s'", "a: '[not json'", "type: person\naliases: [x, y]\nz: '{'"])
def test_render_keeps_what_was_parsed(block):
    import pyarrow as pa

    def parsed(text):
        return next(frontmatter.parse_pages([pa.RecordBatch.from_pydict({"path": ["wiki/a.md"], "file_name": ["a.md"], "content": [text]})])).to_pylist()[0]

    first = parsed(f"---\n{block}\n---\nbody")
    assert parsed(frontmatter.render(first)) == first
