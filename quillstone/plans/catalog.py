"""The catalogue of registered queries over the driver's tables, each with its SQL oracle.

The tables stand in for a vault: documents for raw items and pages, labels for provenance,
conversations for chats, pages for clippings, events for the log, and the foreign keys of nation,
region, customer and supplier for the graph. Each query runs the library's operator on whole tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as fn
from quillstone.operators import claims, graph, ingest, lint, maintenance, paths, resolution, retrieval, status
from quillstone.operators.search import SearchIndex
from quillstone.operators.vectors import VectorIndex
from quillstone.plans import views
from quillstone.shared import fresh, stash, told_apart
from quillstone.sources import vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2001-08-01"  # the last o_orderdate


class Tables:
    """Tables of a directory, by attribute; reading is lazy and pruned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str):
    """Register a function of Tables under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


# --- status -------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS depth, max(doc_id) AS last_id FROM documents GROUP BY source")
def inbox_depth(t):
    return status.inbox_depth(t.documents, "source", "doc_id")


@query("SELECT event_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY event_type")
def last_ingest(t):
    return status.last_ingest(t.events, "event_type")


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang")
def page_counts(t):
    return status.page_counts(t.documents.withColumnRenamed("lang", "type"))


@query("SELECT count(*) AS entries FROM events")
def log_size(t):
    return status.log_size(t.events)


# --- lint ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def lint_orphans(t):
    return lint.orphans(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem, "o_orderkey", "l_orderkey")


@query(f"SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate < DATE '{AS_OF}' - INTERVAL 90 DAY")
def lint_stale(t):
    return lint.stale(t.orders, AS_OF, 90, "o_orderdate").select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def decision_without_sources(t):
    cited = t.labels.groupBy("doc_id").agg(F.collect_set("quality").alias("sources"))
    pages = t.documents.select("doc_id", "source").join(cited, "doc_id", "left").withColumn("type", F.lit("decision"))
    return lint.missing_values(pages, "decision", "sources").select("doc_id", "source")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def person_without_works_at(t):
    # The open orders are the edges: one list per customer, missing where there is none.
    edges = t.orders.where("o_orderstatus = 'O'").select("o_custkey").distinct().select(F.col("o_custkey").alias("c_custkey"), F.array(F.col("o_custkey")).alias("works_at"))
    pages = t.customer.select("c_custkey", "c_name").join(edges, "c_custkey", "left").withColumn("type", F.lit("person"))
    return lint.missing_values(pages, "person", "works_at").select("c_custkey", "c_name")


_CLAIMS = """p AS (SELECT p_partkey AS k, 'p' || p_partkey AS slug, p_size % 3 = 0 AS claims, p_partkey % 11 = 0 AS done FROM part),
open_pairs AS (SELECT DISTINCT least(x.slug, y.slug) AS a, greatest(x.slug, y.slug) AS b FROM p x JOIN p y ON y.k IN (x.k + 1, x.k + 10) WHERE x.claims AND NOT x.done AND NOT y.done)"""


def _claims(t) -> DataFrame:
    """Parts as pages: some contradict the next and the tenth next, some are superseded."""
    key = lambda n: F.concat(F.lit("p"), (F.col("p_partkey") + n).cast("string"))
    claims = F.when(F.col("p_size") % 3 == 0, F.array(key(1), key(10)))
    return t.part.select(key(0).alias("slug"), F.lit("topic").alias("type"), F.lit(None).cast("array<string>").alias("works_at"), F.lit(None).cast("array<string>").alias("sources"), claims.alias("contradicts"), F.when(F.col("p_partkey") % 11 == 0, "x").alias("superseded_by"))


@query(f"WITH {_CLAIMS} SELECT a, b FROM open_pairs")
def contradiction_pairs(t):
    return lint.contradictions(_claims(t))


@query(f"""
SELECT rule, count(*) AS n FROM (
  SELECT 'orphan' AS rule FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
  UNION ALL SELECT 'stale' FROM orders WHERE o_orderdate < DATE '{AS_OF}' - INTERVAL 90 DAY
  UNION ALL SELECT 'no_sources' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) GROUP BY rule""")
def lint_debt(t):
    tag = lambda df, rule: df.select(F.lit(rule).alias("rule"))
    return lint.debt(tag(lint_orphans(t), "orphan").unionAll(tag(lint_stale(t), "stale")).unionAll(tag(decision_without_sources(t), "no_sources")))


# --- collect and ingest -------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS item_key FROM documents GROUP BY text")
def duplicate_skip(t):
    return ingest.keep_first(t.documents.select(fn.content_key("text").alias("item_key"), "doc_id"), "item_key", "doc_id").select("doc_id", "item_key")


@query("""
WITH known AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE doc_id % 4 = 0), new AS (SELECT source, md5(text) AS k FROM documents WHERE doc_id % 4 <> 0)
SELECT source, count(*) FILTER (known.k IS NULL) AS new, count(known.k) AS duplicates FROM new LEFT JOIN known ON new.k = known.k GROUP BY source""")
def collect_report(t):
    d = t.documents.select("doc_id", "source", F.md5("text").alias("item_key"))
    return ingest.collect_report(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), by="source")


@query("""SELECT doc_id, sha256('head' || chr(10) || text || chr(10) || 'later') AS kept, doc_id % 5 = 0 AS conflict FROM documents WHERE text IS NOT NULL""")
def undo_keeps_later(t):
    """A batch put a line into each document, a later one put one at its end, and the first is undone; in each fifth the later one changed that very line."""
    first = lambda line: F.concat(F.lit(f"head\n{line}\n"), F.col("text"))
    pages = t.documents.where("text is not null").select(F.concat(F.lit("wiki/topics/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "doc_id", "text")
    odd = F.col("doc_id") % 5 == 0
    now = F.concat(F.when(odd, first("mine")).otherwise(first("added")), F.lit("\nlater"))
    head = F.concat(F.lit("head\n"), F.col("text"))
    rows = pages.select("path", head.alias("before"), first("added").alias("after"), now.alias("now"), "doc_id", F.col("text").alias("t"))
    changes = rows.select(F.lit("b1").alias("batch_id"), "path", F.lit("update").alias("op"), "before", "after")
    plan = ingest.undo_plan(rows.select("path", F.col("now").alias("content")), changes, "b1")
    body = F.regexp_replace(F.regexp_replace("after", r"\A---\n\n---\n", ""), r"\Ahead\nmine\n", "head\n")
    return plan.select(F.regexp_extract("path", r"(-?\d+)\.md", 1).cast("long").alias("doc_id"), F.sha2(body, 256).alias("kept"), F.col("conflict").isNotNull().alias("conflict"))


@query("SELECT doc_id FROM documents d WHERE doc_id % 4 <> 0 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0)")
def ingest_guard(t):
    d = t.documents.select("doc_id", F.md5("text").alias("item_key"))
    return ingest.unseen(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0")).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents")
def idempotent_upsert(t):
    d = t.documents.select("doc_id", "n_chars")
    once = ingest.upsert(d.where("doc_id % 3 <> 0"), d, "doc_id")
    return ingest.upsert(once, d, "doc_id")


@query("""
SELECT conv_id, turn, kind, CASE kind WHEN 'meeting' THEN 'meetings' WHEN 'decision' THEN 'decisions' WHEN 'source' THEN 'sources' WHEN 'project' THEN 'projects' ELSE 'topics' END AS dir FROM (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'meeting' WHEN regexp_matches(text, '(?i)\\b(?:we|was|were|have) decided\\b|\\bdecision:') THEN 'decision'
  WHEN role = 'assistant' THEN 'source' WHEN regexp_matches(text, '(?i)\\bproject\\b') THEN 'project' ELSE 'topic' END AS kind FROM conversations)""")
def classify_route(t):
    channel = F.when(F.col("role") == "system", "meetings").when(F.col("role") == "assistant", "docs").otherwise("journal")
    routed = ingest.route(t.conversations.withColumn("channel", channel), "channel", "text")
    return routed.select("conv_id", "turn", F.col("type").alias("kind"), "dir")


@query(r"""
SELECT event_id, 'raw/' || event_type || '/' || strftime(ts, '%Y/%m') || '/' || event_id || '.md' AS path,
  strftime(ts, '%Y-%m-%d') || '-' || regexp_replace(regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM events""")
def dated_paths(t):
    name = F.concat(F.col("event_id").cast("string"), F.lit(".md"))
    return t.events.select("event_id", fn.dated_path("event_type", "ts", name).alias("path"), fn.meeting_slug("ts", "event_type").alias("slug"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugs(t):
    return t.part.select("p_partkey", fn.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("""SELECT source AS source_path, 'd' || doc_id AS path, 'update' AS op, count(*) OVER (PARTITION BY source) AS n,
  '--- d' || doc_id || chr(10) || '+++ d' || doc_id || chr(10) || '@@ -1 +1,2 @@' || chr(10) || ' ' || source || chr(10) || '+' || n_chars AS diff FROM documents""")
def consolidated_diff(t):
    after = F.concat_ws("\n", "source", F.col("n_chars").cast("string"))
    changes = t.documents.select(F.col("source").alias("source_path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("update").alias("op"), F.col("source").alias("before"), after.alias("after"))
    return ingest.consolidated(changes)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, source AS content FROM documents WHERE doc_id % 5 <> 1")
def undo_batch(t):
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("content"), "doc_id")
    before = files.where("doc_id % 5 <> 1")
    op = F.when(F.col("doc_id") % 5 == 1, "create").otherwise("update")
    changes = files.where("doc_id % 5 in (1, 2)").select(F.lit("b1").alias("batch_id"), "path", op.alias("op"), F.when(op == "update", F.col("content")).alias("before"), F.upper("content").alias("after"))
    return ingest.undo(ingest.apply(before, changes), changes, "b1")


@query("""SELECT sha256(coalesce(text, '')) AS item_key, count(*) - 1 AS duplicates FROM (SELECT text FROM documents UNION ALL SELECT text FROM documents WHERE doc_id % 10 = 0) GROUP BY coalesce(text, '')""")
def provider_pull(t):
    """Documents that a provider drops in two goes, the second with some of the first again: each item once, and its duplicates."""
    from quillstone.streaming.pull import pull, pulled

    box, table, check = (fresh(t._spark, name) for name in ("exports", "pulled", "pull-checkpoint"))
    rows = t.documents.select("doc_id", F.lit("docs").alias("channel"), "source", F.col("doc_id").cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    for drop in ("doc_id % 2 = 0", "doc_id % 2 <> 0 or doc_id % 10 = 0"):
        rows.where(drop).drop("doc_id").write.mode("append").json(box)
        pull(t._spark, box, table, check, ".json")
    return pulled(t._spark, table).select("item_key", "duplicates")


# --- graph --------------------------------------------------------------------------------------


def _edges(t) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return graph.foreign_key_edges([
        (t.nation, key("n", "n_nationkey"), "part_of", key("r", "n_regionkey")),
        (t.customer, key("c", "c_custkey"), "lives_in", key("n", "c_nationkey")),
        (t.supplier, key("s", "s_suppkey"), "works_at", key("n", "s_nationkey")),
    ])


_EDGES = """edges AS (SELECT 'n' || n_nationkey AS src, 'part_of' AS edge, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'lives_in', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'works_at', 'n' || s_nationkey FROM supplier)"""


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_project(t):
    return _edges(t)


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE edge NOT IN ('part_of', 'works_at')")
def validate_vocab(t):
    e = _edges(t)
    return graph.undeclared(e, t._spark.createDataFrame([("part_of",), ("works_at",)], "edge string"))


@query(f"""WITH {_EDGES}, ways AS (SELECT src AS via, edge, dst AS id FROM edges UNION ALL SELECT dst, edge, src FROM edges)
SELECT DISTINCT id, edge, via FROM ways WHERE via IN ('c0', 'n2')""")
def one_hop(t):
    return graph.expand(t._spark.createDataFrame([("c0",), ("n2",)], "id string"), _edges(t))


@query("""
WITH RECURSIVE step AS (SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation WHERE n_nationkey % 5 <> 0),
walk(start, cur, depth) AS (SELECT src, dst, 1 FROM step UNION ALL SELECT start, s.dst, depth + 1 FROM walk w JOIN step s ON s.src = w.cur WHERE depth < 60)
SELECT start, CASE WHEN max(depth) < 60 THEN max_by(cur, depth) ELSE -1 END AS "end", CASE WHEN max(depth) < 60 THEN max(depth) ELSE -1 END AS hops, max(depth) = 60 AS cyclic FROM walk GROUP BY start""")
def bounded_recursion(t):
    own = t.nation.where("n_nationkey % 5 <> 0")
    ends = graph.follow(own.select(F.col("n_nationkey").alias("src"), ((7 * F.col("n_nationkey") + 3) % 25).cast("int").alias("dst")))
    return ends.fillna(-1, ["end", "hops"])


@query("""
WITH RECURSIVE step AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0),
walk AS (SELECT src, dst, 1 AS hops FROM step UNION ALL SELECT w.src, s.dst, w.hops + 1 FROM walk w JOIN step s ON s.src = w.dst)
SELECT src AS start, max_by(dst, hops) AS "end", CAST(max(hops) AS INTEGER) AS hops, false AS cyclic FROM walk GROUP BY src""")
def supersession_chain(t):
    own = t.part.where("p_partkey > 0")
    return graph.follow(own.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst")))


@query(f"WITH {_EDGES} SELECT src, edge, dst FROM edges WHERE edge = 'part_of' UNION SELECT src, edge, dst FROM edges WHERE edge = 'works_at' AND CAST(substr(src, 2) AS INTEGER) % 2 = 0")
def promote_edges(t):
    e = _edges(t)
    queued = e.where("edge = 'works_at'")
    decisions = queued.withColumn("decision", F.when(F.substring("src", 2, 20).cast("int") % 2 == 0, "confirm").otherwise("skip"))
    return graph.promote(e.where("edge = 'part_of'"), queued, decisions)


@query("""SELECT '{"id":"n' || n_nationkey || '","type":"file","label":"nation"}' AS json FROM nation UNION ALL
SELECT '{"id":"n' || n_nationkey || '-part_of-r' || n_regionkey || '","fromNode":"n' || n_nationkey || '","toNode":"r' || n_regionkey || '","label":"part_of"}' FROM nation""")
def canvas_export(t):
    nodes = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("type"))
    return graph.canvas(nodes, _edges(t).where("edge = 'part_of'"))


# --- claims -------------------------------------------------------------------------------------

_SAID = """said AS (SELECT 'customer-' || o_custkey AS subject, trim(split_part(o_orderpriority, '-', 2)) AS value, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS valid_from, CAST(o_orderdate AS TIMESTAMP) AS heard FROM orders),
one AS (SELECT subject, value, valid_from, min(heard) AS heard, coalesce(valid_from, CAST(min(heard) AS DATE)) AS since, count(*) AS n FROM (SELECT DISTINCT * FROM said) GROUP BY subject, value, valid_from),
named AS (SELECT *, subject || '/order_class/' || left(sha256(value || chr(10) || coalesce(CAST(valid_from AS VARCHAR), '')), 12) AS slug FROM one)"""


def _said(t) -> DataFrame:
    """Orders as notes on their customers: what class the order has, and since when if it is finished."""
    kind = F.trim(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    since = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" since "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise("")
    content = F.concat(F.lit("Some news.\nCustomer-"), F.col("o_custkey").cast("string"), F.lit("'s order class is "), kind, since, F.lit(".\n"))
    items = t.orders.select(F.lit("note").alias("path"), content.alias("content"), F.col("o_orderdate").cast("timestamp").alias("captured_at"))
    return claims.extract(items)


@query(f"""WITH {_SAID} SELECT slug, value, n, CASE WHEN pv <> value AND NOT coalesce(valid_from > ps, false) THEN ps_slug END AS contradicts, CASE WHEN nv <> value AND coalesce(nf > since, false) THEN n_slug END AS superseded_by
FROM (SELECT *, lag(value) OVER w AS pv, lag(since) OVER w AS ps, lag(slug) OVER w AS ps_slug, lead(value) OVER w AS nv, lead(valid_from) OVER w AS nf, lead(slug) OVER w AS n_slug FROM named WINDOW w AS (PARTITION BY subject ORDER BY heard, valid_from NULLS FIRST, value))""")
def claim_history(t):
    return claims.settle(_said(t)).select("slug", "value", "n", F.element_at("contradicts", 1).alias("contradicts"), "superseded_by")


@query(f"""WITH {_SAID} SELECT c_custkey, (SELECT max({{'f': coalesce(valid_from, CAST(heard AS DATE)), 'h': heard, 'value': value}}).value FROM said WHERE subject = 'customer-' || c_custkey AND coalesce(valid_from, CAST(heard AS DATE)) <= DATE '1997-06-30' AND heard <= TIMESTAMP '1998-01-01') AS value FROM customer""")
def claims_as_of(t):
    """Every customer's class in the middle of 1997 by what was known at its end."""
    asked = t.customer.select("c_custkey", F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("order_class").alias("attribute"), F.lit(datetime.date(1997, 6, 30)).alias("day"), F.lit("1998-01-01").cast("timestamp").alias("known"))
    return claims.as_of(asked, _said(t)).select("c_custkey", "value")


# --- retrieval ----------------------------------------------------------------------------------

_TERMS = ("the", "ther", "leaux")
_BM25 = r"""tok AS (SELECT doc_id AS id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT id, len(w) AS dl, q.t, len([x FOR x IN w IF x = q.t]) AS tf FROM tok, (VALUES ('the'), ('ther'), ('leaux')) q(t)),
dfs AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY t),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN dfs USING (t), st WHERE tf > 0 GROUP BY id)"""
_COSINE = "cs AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)"
_stored: dict[tuple, object] = {}


def _once(t, name: str, make):
    """What `make` gives, made once a session and directory: an index or a vault, as a user would store it."""
    key = (t._spark.sparkContext.applicationId, t._dir, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def _index(t) -> tuple[DataFrame, tuple[int, int]]:
    """The stored search index of all documents, and its figures."""

    def make():
        index = stash(retrieval.postings(t.documents), "postings")
        return index, tuple(retrieval.lengths(index).first())

    return _once(t, "index", make)


def _bm25(t) -> DataFrame:
    index, figures = _index(t)
    return retrieval.bm25_stored(index, list(_TERMS), figures)


def _cosine(t) -> DataFrame:
    first = t.embeddings.where("vec_id = 0").select("embedding").first()
    return retrieval.cosine(t.embeddings, first[0] if first else [])


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_topk(t):
    return retrieval.top(_bm25(t), 20, 6)


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm")
def bm25_scan(t):
    """Every score without a stored index."""
    return retrieval.bm25(t.documents, list(_TERMS)).withColumn("score", F.round("score", 6))


def _search(t) -> tuple[SearchIndex, tuple[int, int, int]]:
    """An index of earlier documents brought up to date with all documents, and what that took.

    Earlier, each hundredth text began with another word, each hundredth was missing, and as many were there that have gone since.
    """

    def make():
        index = SearchIndex(t._spark, fresh(t._spark, "search"))
        now = t.documents.select(F.col("doc_id").cast("string").alias("id"), "text", (F.col("doc_id") % 100).alias("r"))
        was = now.where("r <> 1").withColumn("text", F.when(F.col("r") == 0, F.concat(F.lit("zebra "), "text")).otherwise(F.col("text")))
        index.update(was.unionAll(now.where("r = 2").withColumn("id", F.concat(F.lit("-"), "id"))))
        return index, index.update(now)

    return _once(t, "search", make)


@query(r"""WITH t AS (SELECT doc_id % 100 AS r, len(list_distinct([x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''])) AS n FROM documents)
SELECT count(*) FILTER (r IN (0, 1)) AS comes, count(*) FILTER (r IN (0, 2)) AS goes, CAST(coalesce(sum(n) FILTER (r IN (0, 1)), 0) AS BIGINT) AS written FROM t""")
def search_update(t):
    """What an update of a search index wrote: the postings of what came and no others."""
    return t._spark.createDataFrame([_search(t)[1]], "comes long, goes long, written long")


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id::VARCHAR LIMIT 20")
def search_topk(t):
    """The best documents by the index of segments, windows that can't have any left out; ties by the ids' text."""
    return _search(t)[0].top(list(_TERMS), 20).rows.select(F.col("id").cast("long").alias("id"), "score")


@query("SELECT 1 AS k, true AS fewer UNION ALL SELECT 3, true")
def search_work(t):
    """Whether fewer postings were read than the terms have."""
    found = {k: _search(t)[0].top(list(_TERMS), k) for k in (1, 3)}
    return t._spark.createDataFrame([(k, f.read < f.postings) for k, f in found.items()], "k int, fewer boolean")


@query(r"SELECT x AS term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS x FROM documents) WHERE x <> '' GROUP BY x")
def term_counts(t):
    return _index(t)[0].where("term is not null").groupBy("term").agg(F.sum("tf").alias("n"))


@query(f"WITH {_COSINE} SELECT id, round(score, 5) AS score FROM cs ORDER BY round(score, 5) DESC, id LIMIT 20")
def vector_topk(t):
    return retrieval.top(_cosine(t), 20, 5)


def _vectors(t) -> VectorIndex:
    def make():
        index = VectorIndex(t._spark, fresh(t._spark, "vectors"))
        index.build(t.embeddings)
        return index

    return _once(t, "vectors", make)


@query("SELECT count(*) AS queries, true AS recalled, true AS fraction FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(t):
    """Each hundredth vector's 20 nearest by the index: whether 0.9 of those of the full scan are found, by reading, besides the 20 themselves, less than a quarter of the table for each."""
    index, asked = _vectors(t), t.embeddings.where("vec_id % 100 = 0")
    found, true = (index.search(asked, 20, exact=e).select("qid", "id") for e in (False, True))
    hits = asked.select(F.col("vec_id").cast("string").alias("qid")).join(true, "qid", "left").join(found.withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    met = hits.agg(F.count_distinct("qid").alias("queries"), F.coalesce(F.sum("hit") / F.count("id") >= 0.9, F.count("id") == 0).alias("recalled"))
    return met.crossJoin(index.costs(asked, 20).agg(F.coalesce(F.bool_and(F.col("read") - F.col("least") < 0.25 * F.col("whole")), F.lit(True)).alias("fraction")))  # a row each


@query(f"WITH {_COSINE} SELECT id, round(score, 5) AS score FROM cs ORDER BY round(score, 5) DESC, id::VARCHAR LIMIT 20")
def vector_index_exact(t):
    """The index's exact switch."""
    first = t.embeddings.where("vec_id = 0").select("embedding").first()
    scored = retrieval.cosine(_vectors(t).vectors(), first[0] if first else [], "id", "vector")
    return retrieval.top(scored, 20, 5).select(F.col("id").cast("long").alias("id"), "score")


_RRF = f"""{_BM25}, {_COSINE}, x AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 50), y AS (SELECT id, round(score, 5) AS score FROM cs ORDER BY score DESC, id LIMIT 50),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM x UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM y)"""


def _fused(t) -> DataFrame:
    return retrieval.fuse(retrieval.top(_bm25(t), 50, 6), retrieval.top(_cosine(t), 50, 5), 200)


@query(f"WITH {_RRF} SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM r GROUP BY id ORDER BY rrf DESC, id LIMIT 20")
def hybrid_rrf(t):
    return _fused(t).withColumn("rrf", F.round("rrf", 9)).orderBy(F.desc("rrf"), "id").limit(20)


@query(f"WITH {_RRF} SELECT id, round(sum(1.0::DOUBLE / (60 + r)) * CASE WHEN id % 3 = 0 AND id IN (SELECT doc_id FROM documents) THEN 2 ELSE 1 END, 9) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 20")
def rerank_topk(t):
    near = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return retrieval.top(retrieval.rerank(_fused(t).withColumnRenamed("rrf", "score"), near), 20, 9)


@query("SELECT DISTINCT n_nationkey AS id FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_7', 'nation 3', 'nation 7', 'nation3', 'nation7', 'france', 'germany')")
def query_entities(t):
    aliases = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("alias"))
    return retrieval.recognise("how do NATION_3, nation 7, France and Germany compare?", aliases)


@query(r"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id AS path, CAST(line AS INTEGER) AS line, text FROM ln WHERE list_has_any(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'ther', 'leaux'])""")
def citations(t):
    hits = _bm25(t).where("score > 0").select(F.col("id").alias("path"))
    return retrieval.cite(hits, t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), list(_TERMS))


@query(r"""WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS w FROM documents)
SELECT doc_id AS path, a.id FROM d, (VALUES (1, 'worthless'), (2, 'this the'), (2, 'the this'), (3, 'que le des'), (4, 'not in there at all')) a(id, alias) WHERE contains(w, ' ' || alias || ' ') GROUP BY ALL""")
def mention_rows(t):
    aliases = t._spark.createDataFrame([(1, "Worthless"), (2, "this-the"), (2, "the this"), (3, "Que le des"), (4, "not in there at all")], "id int, alias string")
    return retrieval.mentions(t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), aliases)


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def clippings_text(t):
    return t.pages.select("page_id", vault.html_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, trim(unnest(regexp_extract_all(replace(replace(html, '<a href="', '[['), '">', ']]'), '\[\[([^\]|#]+)', 1))) AS dst FROM pages""")
def extract_links(t):
    """Links of clipped pages, put as wikilinks."""
    body = F.replace(F.replace("html", F.lit('<a href="'), F.lit("[[")), F.lit('">'), F.lit("]]"))
    return t.pages.select("page_id", F.explode(fn.wikilinks(body)).alias("dst"))


def _reports(t) -> DataFrame:
    """The graph's edges, and customers who report to one another as a tree, some of whom deputise for one below."""
    c = t.customer.select("c_custkey")
    name = lambda x: F.concat(F.lit("c"), x.cast("long").cast("string"))
    up = c.where("c_custkey > 1").select(name(F.col("c_custkey")).alias("src"), F.lit("reports_to").alias("edge"), name(F.floor(F.col("c_custkey") / 3)).alias("dst"))
    down = c.where("c_custkey % 11 = 0").select(name(F.col("c_custkey")).alias("src"), F.lit("deputises").alias("edge"), name(F.col("c_custkey") * 3).alias("dst"))
    return _edges(t).unionAll(up).unionAll(down)


_REPORTS = f"""{_EDGES}, all_edges AS (SELECT * FROM edges UNION ALL SELECT 'c' || c_custkey, 'reports_to', 'c' || (c_custkey // 3) FROM customer WHERE c_custkey > 1
  UNION ALL SELECT 'c' || c_custkey, 'deputises', 'c' || (3 * c_custkey) FROM customer WHERE c_custkey % 11 = 0)"""


@query(f"""WITH RECURSIVE {_REPORTS}, walk(start, node, state) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer
UNION SELECT w.start, e.dst, CASE edge WHEN 'lives_in' THEN 2 WHEN 'part_of' THEN 3 ELSE 1 END FROM walk w JOIN all_edges e ON e.src = w.node
  AND (edge IN ('reports_to', 'deputises') AND state < 2 OR edge = 'lives_in' AND state = 1 OR edge = 'part_of' AND state = 2))
SELECT DISTINCT start, node FROM walk WHERE state IN (2, 3)""")
def path_reach(t):
    """Where those live to whom a customer reports, however far up, by walks that go through cycles."""
    seeds = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return paths.walks("(reports_to|deputises)+/lives_in/part_of?", _reports(t), seeds).select("start", "node")


@query(f"""WITH RECURSIVE {_REPORTS}, walk(n0, n1, e1) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer
UNION SELECT n0, e.dst, e1 + 1 FROM walk w JOIN all_edges e ON e.src = w.n1 AND edge IN ('reports_to', 'deputises', 'lives_in') WHERE e1 < 4)
SELECT n0, min(e1) AS e1, n1 FROM walk WHERE e1 > 0 GROUP BY n0, n1""")
def path_lengths(t):
    """A pattern's step of one to four edges, with the least number of them, between all nodes."""
    edges = _reports(t)
    nodes = told_apart(edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))).withColumn("type", F.substring("id", 1, 1))
    return graph.match("(c)-[reports_to|deputises|lives_in*1..4]->()", nodes, edges)


# --- maintenance --------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN n.n_nationkey % 2 = 0 THEN 'renamed-' || n.n_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey")
def rename_slug(t):
    names = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("old"), F.concat(F.lit("renamed-"), F.col("n_nationkey").cast("string")).alias("new"))
    return maintenance.rename(t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), names, "nation")


@query("""SELECT 2 * c_custkey AS id, 2 * c_custkey AS entity, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS n FROM customer
UNION ALL SELECT 2 * c_custkey + 1, 2 * c_custkey, 2 FROM customer WHERE c_custkey % 5 = 0""")
def entities(t):
    """Customers as people, a fifth of them again with their names turned round, with an initial or misspelt, half of those without their mail."""
    k = F.col("c_custkey").cast("string")
    c = t.customer.select(
        "c_custkey",
        F.substring(F.md5(F.concat(F.lit("f"), (F.col("c_custkey") % 97).cast("string"))), 1, 5).alias("first"),
        F.substring(F.md5(F.concat(F.lit("l"), k)), 1, 8).alias("last"),
        F.col("c_nationkey").alias("nation"),
        F.concat(F.md5(F.concat(F.lit("m"), k)), F.lit("@x")).alias("mail"),
    )
    own = c.select((2 * F.col("c_custkey")).alias("id"), F.concat_ws(" ", "first", "last").alias("name"), "nation", "mail")
    turned, initial = F.concat(F.upper("last"), F.lit(", "), "first"), F.concat_ws(" q. ", "first", "last")
    misspelt = F.concat(F.col("first"), F.lit(" "), F.substring("last", 1, 4), F.lit("z"), F.substring("last", 5, 4))
    name = F.when(F.col("c_custkey") % 3 == 0, turned).when(F.col("c_custkey") % 3 == 1, initial).otherwise(misspelt)
    again = c.where("c_custkey % 5 = 0").select((2 * F.col("c_custkey") + 1).alias("id"), name.alias("name"), "nation", F.when(F.col("c_custkey") % 2 == 0, F.col("mail")).alias("mail"))
    return resolution.resolve(own.unionByName(again), "id", "name", ("nation", "mail")).withColumn("n", F.col("n").cast("int"))


@query("SELECT md5(text) AS identity, min(doc_id) AS keeper, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def merge_pages(t):
    rows = t.documents.select(F.md5("text").alias("identity"), "doc_id", F.array("source").alias("sources"))
    return maintenance.merge(rows, "identity", "doc_id", "sources").where("n > 1").select("identity", "keeper", "n", F.array_join("sources", ",").alias("sources"))


@query("""SELECT a.c_name AS stub, b.c_name AS slug, CAST(levenshtein(a.c_name, b.c_name) AS INTEGER) AS distance FROM customer a JOIN customer b
ON a.c_custkey % 7 = 0 AND b.c_custkey % 7 <> 0 AND levenshtein(a.c_name, b.c_name) <= 1""")
def link_candidates(t):
    name = lambda df: df.select(F.col("c_name").alias("slug"))
    return maintenance.link_candidates(name(t.customer.where("c_custkey % 7 = 0")), name(t.customer.where("c_custkey % 7 <> 0")), 1)


@query(f"SELECT 'o' || o_orderkey AS from_slug, 'archive/o' || o_orderkey AS to_slug FROM orders WHERE o_orderdate < DATE '{AS_OF}' - INTERVAL 2000 DAY")
def archive_redirects(t):
    pages = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderdate").alias("last_verified"), F.lit("wiki/topics/x.md").alias("path"))
    return maintenance.archive(pages, lint.stale(pages, AS_OF, 2000))[1]


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 3 THEN 'n10' WHEN s_nationkey = 10 THEN 'n10' ELSE 'n' || s_nationkey END AS nation FROM supplier")
def redirect_resolution(t):
    redirects = t._spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n2", "n10"), ("n20", "n21"), ("n21", "n20")], "from_slug string, to_slug string")
    rows = t.supplier.select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("nation"))
    return maintenance.resolve(rows, redirects, "nation")


@query("""SELECT doc_id AS slug, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ord, trim(unnest(string_split(text, chr(10))), ' ') AS text FROM documents WHERE n_chars > 5000""")
def refactor_split(t):
    marked = t.documents.where("n_chars > 5000").select("doc_id", F.regexp_replace("text", "\n", "\n## x\n").alias("body"))
    return maintenance.split_bloated(marked, 5000, "doc_id").select("slug", "ord", "text")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def compile_scope(t):
    scope = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return maintenance.scoped(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), scope, "l_orderkey")


@query("""SELECT layer, path, text FROM (SELECT 'raw' AS layer, 'c' || conv_id || '/' || turn AS path, text FROM conversations UNION ALL SELECT 'wiki', 'd' || doc_id, text FROM documents)
WHERE contains(lower(text), 'worthless') ORDER BY path""")
def thread_timeline(t):
    raw = t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"), "text", F.col("turn").alias("at"))
    wiki = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text", F.col("doc_id").alias("at"))
    return maintenance.thread(raw, wiki, "worthless").select("layer", "path", "text")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_per_day(t):
    from quillstone.streaming.inbox import events_per_window

    out = events_per_window(t.events)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- views --------------------------------------------------------------------------------------

# The stand-ins' columns under the views' names; a fifth of the rows each is in the inbox and in quarantine.
_FILES = """files AS (SELECT 'd' || doc_id AS file_name, CASE doc_id % 5 WHEN 0 THEN 'raw/inbox/' WHEN 1 THEN 'raw/quarantine/' ELSE 'raw/docs/' END || doc_id AS path,
  source, lang AS channel, n_chars AS captured_at FROM documents)"""
_PAGES = """vp AS (SELECT 'o' || o_orderkey AS file_name, CASE o_orderstatus WHEN 'F' THEN 'person' WHEN 'O' THEN 'decision' ELSE 'topic' END AS type, o_orderkey AS k,
  o_orderdate AS created, o_orderdate AS last_verified, o_orderpriority AS status FROM orders)"""


def _files(t) -> DataFrame:
    place = F.when(F.col("doc_id") % 5 == 0, "raw/inbox/").when(F.col("doc_id") % 5 == 1, "raw/quarantine/").otherwise("raw/docs/")
    key = F.col("doc_id").cast("string")
    return t.documents.select(F.concat(F.lit("d"), key).alias("file_name"), F.concat(place, key).alias("path"), "source", F.col("lang").alias("channel"), F.col("n_chars").alias("captured_at"))


def _pages(t) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "person").when(F.col("o_orderstatus") == "O", "decision").otherwise("topic")
    return t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file_name"), kind.alias("type"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("last_verified"), F.col("o_orderpriority").alias("status"))


for _name, _view, _src, _where in (
    ("inbox_status", "inbox-status", _FILES, "path LIKE 'raw/inbox/%'"),
    ("quarantine", "quarantine", _FILES, "path LIKE 'raw/quarantine/%'"),
    ("lint_orphans", "lint-orphans", _PAGES, "k NOT IN (SELECT l_orderkey FROM lineitem)"),
    ("lint_stale", "lint-stale", _PAGES, f"last_verified < DATE '{AS_OF}' - INTERVAL 90 DAY"),
):
    _cols = ", ".join(views.alias(c) for c in views.VIEWS[_view].columns)
    _from = "files" if _src is _FILES else "vp"
    _keep = {
        "inbox_status": lambda t: views.folder("inbox"),
        "quarantine": lambda t: views.folder("quarantine"),
        "lint_orphans": lambda t: lambda rows: lint.orphans(rows, t.lineitem, "k", "l_orderkey"),
        "lint_stale": lambda t: lambda rows: lint.stale(rows, AS_OF),
    }[_name]
    _rows = _files if _src is _FILES else _pages
    QUERIES[f"view_{_name}"] = lambda spark, d, v=_view, rows=_rows: views.as_written(views.VIEWS[v], rows(Tables(spark, d)))
    ORACLES[f"view_{_name}"] = f"WITH {_src} SELECT {_cols} FROM {_from}"
    QUERIES[f"view_{_name}_intended"] = lambda spark, d, v=_view, rows=_rows, keep=_keep: views.as_intended(views.VIEWS[v], rows(t := Tables(spark, d)), keep(t))
    ORACLES[f"view_{_name}_intended"] = f"WITH {_src} SELECT {_cols} FROM {_from} WHERE {_where}"


_INVARIANTS = """ip AS (SELECT 'd' || d.doc_id AS file_name, CASE lang WHEN 'en' THEN 'person' WHEN 'de' THEN 'decision' ELSE 'topic' END AS type, CASE WHEN n_chars % 2 = 0 THEN source END AS works_at,
  'l' || l.quality AS sources, CASE WHEN n_chars % 5 = 0 THEN 'd' || (d.doc_id + 1) END AS contradicts, lang AS status, n_chars % 7 = 0 AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id)"""
_INV_COLS = ", ".join(views.alias(c) for c in views.VIEWS["graph-invariants"].columns)


def _invariant_pages(t) -> DataFrame:
    """Documents as pages: labels as sources, source as employer, the next document contradicted by some, lang as type."""
    cited = t.labels.select("doc_id", F.concat(F.lit("l"), F.col("quality").cast("string")).alias("l")).distinct()
    kind = F.when(F.col("lang") == "en", "person").when(F.col("lang") == "de", "decision").otherwise("topic")
    key = lambda n: F.concat(F.lit("d"), (F.col("doc_id") + n).cast("string"))
    one = lambda when, c: F.when(when, F.array(c))
    rows = t.documents.join(cited, "doc_id", "left")
    return rows.select(
        key(0).alias("slug"), key(0).alias("file_name"), kind.alias("type"), F.col("lang").alias("status"), one(F.col("n_chars") % 2 == 0, F.col("source")).alias("works_at"),
        one(F.col("l").isNotNull(), F.col("l")).alias("sources"), one(F.col("n_chars") % 5 == 0, key(1)).alias("contradicts"), F.when(F.col("n_chars") % 7 == 0, "x").alias("superseded_by"),
    )


def _flat(pages: DataFrame) -> DataFrame:
    return pages.withColumns({c: F.element_at(c, 1) for c in ("works_at", "sources", "contradicts")})


@query(f"WITH {_INVARIANTS} SELECT {_INV_COLS} FROM ip")
def view_graph_invariants(t):
    return views.as_written(views.VIEWS["graph-invariants"], _flat(_invariant_pages(t)))


@query(f"""WITH {_INVARIANTS}, bad AS (SELECT a.file_name AS x, b.file_name AS y FROM ip a JOIN ip b ON a.contradicts = b.file_name WHERE NOT a.done AND NOT b.done)
SELECT {_INV_COLS} FROM ip WHERE type = 'person' AND works_at IS NULL OR type = 'decision' AND sources IS NULL OR file_name IN (SELECT x FROM bad UNION SELECT y FROM bad)""")
def view_graph_invariants_intended(t):
    def broken(rows):
        found = lint.invariants(rows)
        return rows.join(found.select("slug").union(found.where("rule = 'unresolved_contradiction'").select("detail")).distinct(), "slug", "left_semi")

    return views.as_intended(views.VIEWS["graph-invariants"], _flat(broken(_invariant_pages(t))), lambda rows: rows)


@query(f"""WITH {_INVARIANTS}, bad AS (SELECT DISTINCT least(a.file_name, b.file_name) AS x, greatest(a.file_name, b.file_name) AS y FROM ip a JOIN ip b ON a.contradicts = b.file_name WHERE NOT a.done AND NOT b.done)
SELECT 'person_without_works_at' AS rule, file_name AS slug, NULL::VARCHAR AS detail FROM ip WHERE type = 'person' AND works_at IS NULL
UNION ALL SELECT 'decision_without_sources', file_name, NULL FROM ip WHERE type = 'decision' AND sources IS NULL UNION ALL SELECT 'unresolved_contradiction', x, y FROM bad""")
def invariant_findings(t):
    return lint.invariants(_invariant_pages(t))
