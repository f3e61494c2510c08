"""A small vault end to end: reading, lint, graph, retrieval, ingest, undo and upkeep."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.functions import frontmatter, text
from quillstone.operators import graph, ingest, lint, maintenance, retrieval, status
from quillstone.plans import views
from quillstone.sources import vault

PAGES = {
    "people/cora-lind.md": "---\ntype: person\naliases: [Cora Lind, Cora]\nworks_at:\n  - alder\nsources: [raw/meetings/2026/05/q2.md]\nlast_verified: 2026-05-02\n---\nWorks on the [[energy-plan|plan]].\n\n## Mentions\n- first\n",
    "people/selma.md": "---\ntype: person\nworks_at: null\nlast_verified: 2026-01-31\n---\nSee [[cora-lind#Mentions]] and [[nobody]].\n",
    "people/dan.md": "---\ntype: person\nworks_at: []\n---\nNothing.\n",
    "orgs/alder.md": "---\ntype: org\nlast_verified: 2026-02-01\nattended: [plan-review]\n---\nAn org. [[alder]]\n",
    "decisions/size-999.md": "---\ntype: decision\nsources: [raw/meetings/2026/05/q2.md]\ncontradicts: [size-9995]\nlast_verified: 2026-05-01\n---\nSize 99.9\n\n---\n\nrule above\n",
    "decisions/size-9995.md": "---\ntype: decision\ncontradicts: [size-999]\nlast_verified: 2026-05-01\n---\nSize 99.95\n",
    "topics/energy-plan.md": "---\nlast_verified: 2026-05-01\ndecided: [size-999]\n---\nThe energy plan was set in [[size-999]].\n",
    "tofile/plain.md": "No frontmatter at all.\n",
    "_inbox/edges.md": "(plan-review) --decided--> (size-999)   conf 0.9\n- (cora-lind) --works_at--> (alder) conf 0.6\n(selma)  --works_at--> (alder)  conf 0.3\n",
}
RAW = {
    "inbox/meetings/a.md": "---\nsource: mic\ncaptured_at: 2026-05-25 10:00:00\n---\nWe decided to move the Size.\n",
    "inbox/emails/b.md": "plain mail\n",
    "quarantine/2026/05/c.md": "odd\n",
    "meetings/2026/05/q2.md": "intro\nthe energy plan was decided\nend\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("vault"))
    maintenance.scaffold(base)
    for folder, files in (("wiki", PAGES), ("raw", RAW)):
        for name, content in files.items():
            path = os.path.join(base, folder, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(content)
    return base


@pytest.fixture(scope="module")
def pages(spark, root):
    return vault.pages(spark, root)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pages(pages):
    found = {r["slug"]: r for r in pages.collect()}
    assert len(found) == 8
    assert found["cora-lind"]["works_at"] == ["alder"] and found["cora-lind"]["last_verified"] == datetime.date(2026, 5, 2)
    assert found["selma"]["works_at"] is None and found["dan"]["works_at"] is None
    assert found["energy-plan"]["type"] == "topic" and found["plain"]["type"] == "tofile"
    assert found["plain"]["body"] == "No frontmatter at all.\n"
    assert "\n---\n" in found["size-999"]["body"]


def test_frontmatter_round_trip_and_fallback(pages):
    page = next(r.asDict(recursive=True) for r in pages.collect() if r["slug"] == "cora-lind")
    again = next(frontmatter.parse_pages([_batch(page["path"], page["file_name"], frontmatter.render(page))])).to_pylist()[0]
    assert {k: again[k] for k in ("type", "works_at", "sources", "last_verified", "body")} == {k: page[k] for k in ("type", "works_at", "sources", "last_verified", "body")}
    assert frontmatter.split("no fence") == ("", "no fence")


def _batch(*values):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["path", "file_name", "content"])


def test_raw_items(spark, root):
    items = vault.inbox(spark, root)
    assert rows(items, "file_name", "channel", "source", "state") == [("a.md", "meetings", "mic", "inbox"), ("b.md", "emails", None, "inbox")]
    assert items.where("source = 'mic'").first()["captured_at"] == datetime.datetime(2026, 5, 25, 10)
    assert rows(vault.quarantine(spark, root), "file_name", "state") == [("c.md", "quarantine")]
    assert vault.raw_items(spark, root).count() == 4
    assert rows(status.inbox_depth(items), "channel", "depth") == [("emails", 1), ("meetings", 1)]
    assert rows(views.as_written(views.VIEWS["inbox-status"], items.withColumn("file_name", F.col("file_name"))), "file_name") == [("a.md",), ("b.md",)]
    assert rows(views.as_intended(views.VIEWS["quarantine"], vault.raw_items(spark, root), views.folder("quarantine")), "file_name") == [("c.md",)]


def test_view_files():
    view = views.load('//: a comment\n//2: "more"\nview: table\nfilter: {}\ncolumns:\n  - file.name\n  - type\nviews:\n  - type: table\n    name: Table\n', "x")
    assert view.columns == ["file.name", "type"] and view.filter == {} and view.views == [{"type": "table", "name": "Table"}]


def test_lint(pages):
    found = lint.lint(pages, "2026-05-02")
    got = {}
    for r in found.collect():
        got.setdefault(r["rule"], set()).add((r["slug"], r["detail"]))
    assert {s for s, _ in got["person_without_works_at"]} == {"selma", "dan"}
    assert {s for s, _ in got["decision_without_sources"]} == {"size-9995"}
    assert got["unresolved_contradiction"] == {("size-999", "size-9995")}
    assert {s for s, _ in got["orphan"]} == {"selma", "dan", "size-9995", "plain"}  # alder links to itself
    assert {s for s, _ in got["stale"]} == {"selma"}  # 91 days; alder's 90 are not
    assert {s for s, _ in got["never_verified"]} == {"dan", "plain"}
    assert got["dangling_link"] == {("selma", "nobody")}
    assert dict(map(tuple, lint.debt(found).collect()))["orphan"] == 4
    assert "- orphan: 4" in status.overview(status.page_counts(pages), lint.debt(found))


def test_resolved_contradiction(pages):
    done = pages.withColumn("superseded_by", F.when(F.col("slug") == "size-999", "size-9995"))
    assert lint.contradictions(done).count() == 0


def test_graph(spark, root, pages):
    nodes, edges = graph.project(pages)
    assert rows(edges, "src", "edge", "dst") == [("alder", "attended", "plan-review"), ("cora-lind", "works_at", "alder"), ("energy-plan", "decided", "size-999"), ("size-999", "contradicts", "size-9995"), ("size-9995", "contradicts", "size-999")]
    findings = graph.validate(nodes, edges, schemas.vocab_nodes(spark), schemas.vocab_edges(spark))
    assert rows(findings, "rule", "src") == [("missing_page", "alder"), ("wrong_end", "energy-plan")]
    seeds = spark.createDataFrame([("size-999",)], "id string")
    assert rows(graph.expand(seeds, edges, ["decided"]), "id") == [("energy-plan",)]
    queued = vault.proposals(spark, f"{root}/wiki/_inbox/edges.md")
    assert rows(queued, "src", "edge", "dst", "conf") == [("cora-lind", "works_at", "alder", 0.6), ("plan-review", "decided", "size-999", 0.9), ("selma", "works_at", "alder", 0.3)]
    decisions = queued.select("src", "edge", "dst", F.when(F.col("conf") > 0.5, "confirm").otherwise("skip").alias("decision"))
    after = graph.promote(edges, queued, decisions)
    assert after.count() == 6
    merged = graph.into_frontmatter(pages, spark.createDataFrame([("selma", "works_at", "alder")], "src string, edge string, dst string"), "works_at")
    assert merged.where("slug = 'selma'").first()["works_at"] == ["alder"] and merged.count() == 8
    assert graph.canvas(nodes, edges).count() == 13


def test_follow(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x"), ("s", "s")], "src string, dst string")
    got = {r["start"]: (r["end"], r["hops"], r["cyclic"]) for r in graph.follow(steps).collect()}
    assert got == {"a": ("c", 2, False), "b": ("c", 1, False), **dict.fromkeys("xyws", (None, None, True))}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(37)] + [("p", "q"), ("q", "p")], "src string, dst string")
    got = {r["start"]: (r["end"], r["hops"], r["cyclic"]) for r in graph.follow(chain).collect()}
    assert all(got[f"n{i}"] == ("n37", 37 - i, False) for i in range(37)) and got["p"][2] and got["q"][2]
    assert graph.follow(steps.where("false")).collect() == []
    out = maintenance.resolve(spark.createDataFrame([("a",), ("x",), ("z",)], "s string"), steps.toDF("from_slug", "to_slug"), "s")
    assert rows(out, "s") == [("c",), ("x",), ("z",)]


def test_graph_schema(spark, tmp_path):
    (tmp_path / "schema.ddl").write_text("CREATE NODE TABLE Person(id STRING, PRIMARY KEY(id));\nCREATE NODE TABLE Org(id STRING);\nCREATE REL TABLE works_at(FROM Person TO Org);\n")
    nodes, edges = vault.graph_schema(spark, str(tmp_path / "schema.ddl"))
    assert rows(nodes, "type") == [("org",), ("person",)] and rows(edges, "edge", "src_type", "dst_type") == [("works_at", "person", "org")]


def test_query(spark, root, pages):
    _, edges = graph.project(pages)
    lines = vault.lines(vault.raw_items(spark, root)).unionByName(vault.lines(pages.select("path", F.col("body").alias("content"))))
    got = retrieval.query("what about Cora's energy plan?", pages, edges, lines).collect()
    assert ("raw/meetings/2026/05/q2.md", 2, "the energy plan was decided") in {(r["path"], r["line"], r["text"]) for r in got}
    assert retrieval.query("??", pages, edges, lines).count() == 0


def test_ingest_is_idempotent_and_undoable(spark, pages):
    items = spark.createDataFrame([("raw/inbox/meetings/a.md", "meetings", "a.md", datetime.datetime(2026, 5, 25))], "path string, channel string, file_name string, captured_at timestamp")
    mentions = spark.createDataFrame([("raw/inbox/meetings/a.md", "cora-lind", "spoke in a"), ("raw/inbox/meetings/a.md", "new-topic", "came up")], "path string, slug string, bullet string")
    changes = ingest.fan_out(items, mentions, pages, "b1")
    got = {r["path"]: r for r in changes.collect()}
    assert {p: r["op"] for p, r in got.items()} == {"wiki/people/cora-lind.md": "update", "wiki/tofile/new-topic.md": "create"}
    assert "## Mentions\n- spoke in a\n- first" in got["wiki/people/cora-lind.md"]["after"]
    assert "raw/meetings/2026/05/a.md" in got["wiki/people/cora-lind.md"]["after"]
    diff = ingest.consolidated(changes).collect()
    assert [(r["source_path"], r["path"], r["n"]) for r in diff] == [("raw/meetings/2026/05/a.md", p, 2) for p in sorted(got)] and "+- spoke in a" in diff[0]["diff"]
    files = pages.mapInArrow(frontmatter.render_pages, "path string, content string")
    after = ingest.apply(files, changes)
    again = after.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).select("path", "file_name", "content").mapInArrow(frontmatter.parse_pages, schemas.PAGES)
    assert ingest.fan_out(items, mentions, again, "b2").count() == 0
    assert rows(ingest.undo(after, changes, "b1"), "path", "content") == rows(files, "path", "content")


def test_collect(spark):
    items = spark.createDataFrame([("k1", "emails", "p2"), ("k1", "emails", "p1"), ("k2", "meetings", "p3")], "item_key string, channel string, path string")
    known = spark.createDataFrame([("k2",)], "item_key string")
    assert rows(ingest.keep_first(items, "item_key", "path"), "item_key", "path") == [("k1", "p1"), ("k2", "p3")]
    assert rows(ingest.collect_report(items, known), "channel", "new", "duplicates") == [("emails", 2, 0), ("meetings", 0, 1)]
    once = ingest.upsert(known.withColumn("channel", F.lit("x")).withColumn("path", F.lit("p")), items.where("path <> 'p2'"), "item_key")
    assert once.count() == 2 and ingest.upsert(once, items, "item_key").count() == 2


def test_propose_edges(spark):
    rows_ = spark.createDataFrame([("m1", "Cora Lind works at Alder. We decided to adopt the plan.\n(a) --attended--> (b)")], "slug string, body string")
    got = rows(ingest.propose_edges(rows_), "src", "edge", "dst", "conf")
    assert got == [("a", "attended", "b", 0.9), ("cora-lind", "works_at", "alder", 0.6), ("m1", "decided", "adopt-the-plan", 0.5)]
    proposals = ingest.propose_edges(rows_)
    assert ingest.queue(proposals, proposals).count() == 0


def test_two_sources_of_a_page_are_two_diffs(spark, pages):
    at = datetime.datetime(2026, 5, 25)
    items = spark.createDataFrame([(f"raw/inbox/emails/{n}.md", "emails", f"{n}.md", at) for n in "ab"], "path string, channel string, file_name string, captured_at timestamp")
    told = spark.createDataFrame([(f"raw/inbox/emails/{n}.md", slug, f"from {n}") for n in "ab" for slug in ("cora-lind", "fresh")], "path string, slug string, bullet string")
    by_source = ingest.consolidated(ingest.fan_out(items, told, pages, "b")).collect()
    assert [(r["source_path"][-4:], r["path"], r["op"], r["n"]) for r in by_source] == [(s, p, o, 2) for s in ("a.md", "b.md") for p, o in (("wiki/people/cora-lind.md", "update"), ("wiki/tofile/fresh.md", "create"))]
    assert all(("+- from a" in r["diff"]) == (r["source_path"][-4] == "a") and ("+- from b" in r["diff"]) == (r["source_path"][-4] == "b") for r in by_source)
    whole = {r["path"]: r["after"] for r in ingest.fan_out(items, told, pages, "b", by_source=False).collect()}
    assert len(whole) == 2 and all("- from a" in t and "- from b" in t for t in whole.values())


def test_store(spark, tmp_path):
    from quillstone.store import Conflict, Store

    s = Store(spark, f"file://{tmp_path}/t")
    assert s.latest() == (0, {})
    for rows_ in (3, 5):
        number, tables = s.latest()
        s.commit(number, tables | {"pages": {"parts": [s.write(spark.range(rows_), "pages")], "at": number + 1}})
    number, tables = s.latest()
    assert number == 2 and s.read(tables["pages"]["parts"], "id long").count() == 5
    # A second writer that began from the same number is refused, and what it wrote isn't seen.
    s.write(spark.range(9), "pages")
    with pytest.raises(Conflict):
        s.commit(1, {})
    assert s.latest() == (2, tables)
    # A writer that died before its rename leaves nothing that counts, and blocks nobody.
    (tmp_path / "t" / "manifests" / "dead.new").write_text("{")
    assert s.latest()[0] == 2
    s.commit(2, tables)
    assert s.vacuum(keep=1) == 2 and s.read(s.latest()[1]["pages"]["parts"], "id long").count() == 5


def test_upkeep(spark, pages):
    renames = spark.createDataFrame([("alder", "alder-corp")], "old string, new string")
    _, edges = graph.project(pages)
    renamed = maintenance.rename(edges, renames, "src", "dst")
    assert renamed.count() == edges.count() and renamed.where("dst = 'alder-corp'").count() == 1
    assert maintenance.rename(pages, renames, "works_at").where("slug = 'cora-lind'").first()["works_at"] == ["alder-corp"]
    linked = spark.createDataFrame([("[[alder]] [[alder|A]] [[alder-x]]",)], "body string")
    assert maintenance.rename_links(linked, "alder", "corp").first()["body"] == "[[corp]] [[corp|A]] [[alder-x]]"
    two = spark.createDataFrame([("i", "b", ["x"]), ("i", "a", ["y", "x"]), (None, "c", ["z"])], "identity string, slug string, sources array<string>")
    assert rows(maintenance.merge(two, "identity", "slug", "sources"), "identity", "keeper", "n", "sources") == [("i", "a", 2, ["x", "y"])]
    stubs = spark.createDataFrame([("eergy-plan",), ("energy-pln",)], "slug string")
    assert rows(maintenance.link_candidates(stubs, pages.select("slug")), "stub", "slug", "distance") == [("eergy-plan", "energy-plan", 1), ("energy-pln", "energy-plan", 1)]
    moved, redirects = maintenance.archive(pages, lint.stale(pages, "2026-05-02"))
    assert moved.where("path = 'wiki/archive/selma.md'").count() == 1 and rows(redirects, "to_slug") == [("archive/selma",)]
    got = rows(maintenance.split_bloated(pages, 30).where("slug = 'cora-lind'"), "ord", "heading", "text")
    assert got == [(0, None, "Works on the [[energy-plan|plan]]."), (1, "Mentions", "- first")] or len(got) == 2
    tl = maintenance.thread(spark.createDataFrame([("p1", "Energy plan talk", 2)], "path string, text string, at int"), spark.createDataFrame([("p0", "the energy plan", 1)], "path string, text string, at int"), "energy plan")
    assert [r["path"] for r in tl.collect()] == ["p0", "p1"] and "- 1 (wiki, p0)" in maintenance.narrative(tl, "energy plan")


def test_text_functions(spark):
    one = spark.range(1).select(
        text.slugify(F.lit("  Q3: Energy Plan! ")).alias("a"),
        text.meeting_slug(F.lit("2026-05-25").cast("date"), F.lit("Plan review")).alias("b"),
        text.type_dir(F.lit("person")).alias("c"),
        text.append_bullet(F.lit("x"), F.lit("Log"), F.lit("y")).alias("d"),
        text.age_days(F.lit("2026-01-01").cast("date"), F.lit("2026-01-11").cast("date")).alias("e"),
        vault.html_text(F.lit("<p>a &amp; b</p><script>x</script>")).alias("f"),
    ).first()
    assert tuple(one) == ("q3-energy-plan", "2026-05-25-plan-review", "people", "x\n\n## Log\n- y", 10, "a & b")


def test_scaffold_refuses_a_vault(tmp_path):
    (tmp_path / "CONTRACT.md").write_text("")
    with pytest.raises(FileExistsError):
        maintenance.scaffold(str(tmp_path))


def test_incremental_inbox(spark, tmp_path):
    from quillstone.streaming.inbox import ingest_available

    box = tmp_path / "inbox"
    box.mkdir()
    (box / "a.md").write_text("one\ntwo")
    (box / "b.md").write_text("one\ntwo")
    args = [str(box), str(tmp_path / "table"), str(tmp_path / "checkpoint")]
    ingest_available(spark, *args)
    (box / "c.md").write_text("one\ntwo")
    (box / "d.md").write_text("three")
    ingest_available(spark, *args)
    ingest_available(spark, *args)
    assert rows(spark.read.parquet(args[1]), "content") == [("one\ntwo",), ("three",)]


def test_patterns(spark):
    nodes = spark.createDataFrame([("p1", "person"), ("p2", "person"), ("o1", "org"), ("m1", "meeting"), ("d1", "decision")], "id string, type string")
    edges = spark.createDataFrame([("p1", "works_at", "o1"), ("p2", "works_at", "o1"), ("p1", "attended", "m1"), ("m1", "decided", "d1")], "src string, edge string, dst string")
    got = lambda p: sorted(tuple(r) for r in graph.match(p, nodes, edges).collect())
    assert got("(person)") == [("p1",), ("p2",)]
    assert got("(person)-[works_at]->(org)") == [("p1", "works_at", "o1"), ("p2", "works_at", "o1")]
    assert got("(:p1) -[works_at]-> (org) <-[works_at]- (person)") == [("p1", "works_at", "o1", "works_at", "p1"), ("p1", "works_at", "o1", "works_at", "p2")]
    assert got("(:p1)-[]-()-[decided|attended]-(decision)") == [("p1", "attended", "m1", "decided", "d1")]
    assert got("(:p1)-[attended]->()-[]->()") == [("p1", "attended", "m1", "decided", "d1")] and got("(:d1)-[]->()") == []
    for bad in ("", "(a)-[x]->", "(a)(b)", "(a) where"):
        with pytest.raises(ValueError):
            graph.match(bad, nodes, edges)


def test_bullets_belong_to_their_section(spark):
    body = "## Log\n- x\n# Top\n- y\n## Mentions\n- z"
    at = lambda b: spark.range(1).select(text.append_bullet(F.lit(body), F.lit("Mentions"), F.lit(b))).first()[0]
    assert at("z") == body and at("x") == "## Log\n- x\n# Top\n- y\n## Mentions\n- x\n- z"
    assert spark.range(1).select(text.append_bullet(F.lit(body), F.lit("Log"), F.lit("y"))).first()[0] == "## Log\n- y\n- x\n# Top\n- y\n## Mentions\n- z"


def test_a_vault_may_lie_under_any_path(spark, tmp_path):
    base = tmp_path / "raw" / "wiki" / "my vault+"
    for name in ("raw/inbox/emails/a b+c.md", "wiki/topics/x.md", "raw/assets/i.png", "raw/docs/2026/05/d.bin"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("---\ntype: topic\n---\nétext")
    root_ = str(base)
    assert rows(vault.raw_items(spark, root_), "path", "channel", "state") == [("raw/inbox/emails/a b+c.md", "emails", "inbox")]
    assert rows(vault.pages(spark, root_), "path", "slug") == [("wiki/topics/x.md", "x")]
    assert rows(vault.assets(spark, root_), "path") == [("raw/assets/i.png",)]
    got = vault.converted(spark, f"{root_}/raw/docs", lambda path, data: f"{path[-5:]}:{data.decode()[-5:]}", "*.bin")
    assert rows(got, "content") == [("d.bin:étext",)]
    assert vault.write_files(vault.pages(spark, root_).mapInArrow(frontmatter.render_pages, "path string, content string"), f"{root_}/out") == 1
    assert (base / "out/wiki/topics/x.md").read_text() == "---\ntype: topic\n---\nétext"


def test_excluded(spark):
    paths = spark.createDataFrame([(p,) for p in ("wiki/a.md", "wiki/archive/b.md", "raw/x/c.tmp", "raw/x/y/c.md", "draft.md")], "path string")
    left = lambda *patterns: [r[0] for r in rows(vault.excluded(paths, list(patterns)), "path")]
    assert left() == left("# a comment", "") == sorted(r[0] for r in paths.collect())
    assert left("archive/") == ["draft.md", "raw/x/c.tmp", "raw/x/y/c.md", "wiki/a.md"]
    assert left("*.tmp", "raw/**/c.md") == ["draft.md", "wiki/a.md", "wiki/archive/b.md"]


def test_questions_in_other_scripts_and_by_vectors(spark):
    pages_ = spark.createDataFrame([("энергия", "План энергии на год", "wiki/topics/1.md"), ("other", "nothing of it", "wiki/topics/2.md")], "slug string, body string, path string").withColumn("aliases", F.lit(None).cast("array<string>")).withColumn("sources", F.lit(None).cast("array<string>"))
    edges = spark.createDataFrame([], schemas.EDGES)
    lines = vault.lines(pages_.select("path", F.col("body").alias("content")))
    assert rows(retrieval.query("энергии?", pages_, edges, lines), "path", "line") == [("wiki/topics/1.md", 1)]
    index = retrieval.postings(retrieval.searched(pages_), "slug")
    vectors = {r["id"]: r["vector"] for r in retrieval.hashed_vectors(index).collect()}
    assert all(len(v) == retrieval.DIMENSIONS for v in vectors.values()) and set(vectors) == {"энергия", "other"}
    got, want = (dict(rows(df, "id", "score")) for df in (retrieval.bm25_stored(index, ["план", "of"]), retrieval.bm25(retrieval.searched(pages_), ["план", "of"], "slug")))
    assert got.keys() == want.keys() == {"энергия", "other"} and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert retrieval.bm25_stored(index, ["absent"]).collect() == []


def test_long_provider_exports_are_split(spark, tmp_path):
    from quillstone.sources.providers import ExportSource

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("".join(f'{{"channel": "emails", "content": "{"é" * (i % 13)}{i}"}}\n' for i in range(500)) + '{"channel": "chats", "content": "last"}')
    spark.dataSource.register(ExportSource)
    got = spark.read.format("provider_export").option("path", str(tmp_path)).option("splitBytes", 700).load()
    assert got.rdd.getNumPartitions() > 20
    assert sorted(r["content"] for r in got.collect()) == sorted([f"{'é' * (i % 13)}{i}" for i in range(500)] + ["last"])


def test_provider_exports(spark, tmp_path):
    from quillstone.sources.providers import ExportSource

    (tmp_path / "x.jsonl").write_text('{"channel": "emails", "source": "s", "content": "hi"}\n')
    spark.dataSource.register(ExportSource)
    got = spark.read.format("provider_export").option("path", str(tmp_path)).load()
    assert rows(got, "channel", "content") == [("emails", "hi")]


def test_names_of_many_words(spark):
    aliases = spark.createDataFrame([("six", "The Group of Six Wise Owls"), ("dated", "2024 05 01 weekly sync"), ("one", "owl"), ("blank", "--"), ("none", None)], "id string, alias string")
    asked = "What did the group of six wise owls say in 2024-05-01-weekly-sync?"
    assert rows(retrieval.recognise(asked, aliases), "id") == [("dated",), ("six",)]
    assert rows(retrieval.recognise("", aliases), "id") == [] and rows(retrieval.recognise("group of six wise", aliases), "id") == []
    texts = spark.createDataFrame([("a", f"x {asked} y"), ("b", "an owl"), ("c", "the group of six wise"), ("d", None)], "path string, content string")
    assert rows(retrieval.mentions(texts, aliases), "path", "id") == [("a", "dated"), ("a", "six"), ("b", "one")]
    assert rows(retrieval.mentions(texts, aliases.where("false")), "path", "id") == []


def test_links_are_those_of_brute_force(spark):
    import itertools
    import types

    from quillstone.vault import Vault

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    slugs = ["energy-plan", "alder", "cora-lind", "ab", "x"]
    stubs = ["eergy-plan", "energy-pln", "rror-budge", "xalder", "cmae", "ora-lidn", "cora", "ba", "y", "", "alder"]
    table = spark.createDataFrame([(s, "topic") for s in slugs] + [(s, "tofile") for s in stubs], "slug string, type string")
    for distance in (1, 2):
        want = sorted((a, b, edits(a, b)) for a, b in itertools.product(stubs, slugs) if a != b and edits(a, b) <= distance)
        assert rows(Vault.link(types.SimpleNamespace(live=lambda: table), distance), "stub", "slug", "distance") == want


def test_narrative_has_every_entry(spark):
    timeline = spark.range(2500).selectExpr("id AS at", "'raw' AS layer", "concat('p', id) AS path", "'x' AS text").orderBy("at")
    assert maintenance.narrative(timeline, "t").split("\n")[2:] == [f"- {i} (raw, p{i}): x" for i in range(2500)]
