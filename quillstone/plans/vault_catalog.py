"""Queries that run on files and on a vault: scans, frontmatter, sinks and commands, each with its SQL oracle.

A small Markdown vault is written from whole tables into the shared folder: suppliers as people, nations as orgs,
regions as topics, and captured items, transcripts, exports and assets beside them. It is written once a session and
directory, as are the tables of the vault that goes through a day of commands.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.functions import frontmatter
from quillstone.functions import text as fn
from quillstone.operators import graph, ingest, lint, maintenance, retrieval, status
from quillstone.plans.catalog import AS_OF, _once, query
from quillstone.shared import fresh, stash
from quillstone.sources import vault
from quillstone.sources.providers import ExportSource
from quillstone.store import Store
from quillstone.vault import Vault

_CHANNEL = "CASE {} % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(schemas.CHANNELS)) + " END"


def _files(t) -> DataFrame:
    """(path, content) of the vault, by SQL expressions that Spark and DuckDB share."""
    t.supplier.createOrReplaceTempView("quillstone_supplier")
    t.nation.createOrReplaceTempView("quillstone_nation")
    t.region.createOrReplaceTempView("quillstone_region")
    return t._spark.sql("SELECT path, content FROM (" + _FILES.replace(" supplier", " quillstone_supplier").replace(" nation", " quillstone_nation").replace(" region", " quillstone_region") + ")")


_FILES = f"""
SELECT 'wiki/people/s' || s_suppkey || '.md' AS path, concat('---\n', CASE WHEN s_suppkey % 5 <> 0 THEN concat('works_at:\n  - n', s_nationkey, '\n') ELSE '' END, 'sources: [raw/meetings/2001/01/s', s_suppkey,
  '.md]\nlast_verified: 2001-0', 1 + s_suppkey % 7, '-15\nkey: "v', s_suppkey, '"\ntype: person\n---\nWorks with [[n', s_nationkey, '#Top]] and [[s', s_suppkey + 1, '|next]].\n') AS content FROM supplier
UNION ALL SELECT concat('wiki/orgs/n', n_nationkey, '.md'), concat('---\ntype: org\nattended: [r', n_regionkey, ']\n---\n') FROM nation
UNION ALL SELECT concat('wiki/topics/r', r_regionkey, '.md'), concat('No block, on [[r', r_regionkey, ']]\n---\nbelow a rule\n') FROM region
UNION ALL SELECT concat('raw/inbox/', {_CHANNEL.format('s_suppkey')}, '/i', s_suppkey, '.md'), concat('---\nsource: src', s_suppkey % 3, '\ncaptured_at: 2001-05-25 10:00:00\n---\nItem ', s_suppkey, ' in two\nlines\n') FROM supplier
UNION ALL SELECT concat('raw/meetings/2001/01/s', s_suppkey, '.md'), concat('intro\nSam', s_suppkey, ' works at Org', s_nationkey, '.\n(s', s_suppkey, ') --attended--> (n', s_nationkey, ')\nWe decided to keep ', s_suppkey, '.\n') FROM supplier
UNION ALL SELECT concat('raw/quarantine/2001/05/q', n_nationkey, '.md'), concat('odd ', n_nationkey) FROM nation
UNION ALL SELECT concat('raw/assets/a', n_nationkey, '.bin'), repeat('x', 100 + n_nationkey) FROM nation
UNION ALL SELECT concat('raw/docs/2001/05/d', r_regionkey, '.bin'), concat('Binary ', r_name) FROM region
UNION ALL SELECT concat('exports/chats/c', n_nationkey, '.json'), concat('{{"channel": "c', n_nationkey, '", "ts": "2001-05-25T10:00:00Z", "author": "', n_name, '", "text": "hi ', n_nationkey, '"}}\n') FROM nation
UNION ALL SELECT concat('exports/mail/m', n_nationkey, '.jsonl'), concat('{{"channel": "emails", "source": "m", "title": "', n_name, '", "content": "one"}}\n\n{{"channel": "emails", "content": "two ', n_nationkey, '"}}') FROM nation
UNION ALL SELECT 'schema/graph.ddl', 'CREATE NODE TABLE Person(id STRING);\nCREATE NODE TABLE IF NOT EXISTS Org(id STRING);\nCREATE REL TABLE works_at(FROM Person TO Org);\n'
"""
_F = f"f(path, content) AS ({_FILES})"  # its line breaks are real ones, as neither dialect has the same escapes


def _root(t) -> str:
    def make():
        root = fresh(t._spark, "vault")
        vault.write_files(_files(t).repartition(8), root)
        lines = t.supplier.select(F.format_string("- (s%d) --works_at--> (n%d) conf 0.%d", "s_suppkey", "s_nationkey", F.lit(10) + F.col("s_suppkey") % 90))
        lines.write.text(f"{root}/wiki/_inbox/edges.md")
        return root

    return _once(t, "files", make)


def _pages(t) -> DataFrame:
    return _once(t, "pages", lambda: stash(vault.pages(t._spark, _root(t)), "pages"))


# --- scans ----------------------------------------------------------------------------------------

_SLUG = "regexp_extract(path, '([^/]+)\\.md$', 1)"


@query("""SELECT 's' || s_suppkey AS slug, 'person' AS type, 'wiki/people/s' || s_suppkey || '.md' AS path, 's' || s_suppkey || '.md' AS file_name, CASE WHEN s_suppkey % 5 <> 0 THEN 'n' || s_nationkey ELSE '' END AS works_at,
  'raw/meetings/2001/01/s' || s_suppkey || '.md' AS sources, '2001-0' || (1 + s_suppkey % 7) || '-15' AS last_verified, 'key=v' || s_suppkey AS rest,
  'Works with [[n' || s_nationkey || '#Top]] and [[s' || (s_suppkey + 1) || '|next]].' || chr(10) AS body FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'org', 'wiki/orgs/n' || n_nationkey || '.md', 'n' || n_nationkey || '.md', '', '', '', 'attended=["r' || n_regionkey || '"]', '' FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'topic', 'wiki/topics/r' || r_regionkey || '.md', 'r' || r_regionkey || '.md', '', '', '', '', 'No block, on [[r' || r_regionkey || ']]' || chr(10) || '---' || chr(10) || 'below a rule' || chr(10) FROM region""")
def wiki_pages(t):
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    rest = F.array_join(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _pages(t).select("slug", "type", "path", "file_name", joined("works_at"), joined("sources"), F.coalesce(F.col("last_verified").cast("string"), F.lit("")).alias("last_verified"), F.coalesce(rest, F.lit("")).alias("rest"), "body")


@query("""SELECT 'wiki/people/s' || s_suppkey || '.md' AS path, concat('---', chr(10), 'type: person', chr(10), 'last_verified: 2001-0', 1 + s_suppkey % 7, '-15', chr(10), CASE WHEN s_suppkey % 5 <> 0 THEN concat('works_at:', chr(10), '  - n', s_nationkey, chr(10)) ELSE '' END,
  'sources:', chr(10), '  - raw/meetings/2001/01/s', s_suppkey, '.md', chr(10), 'key: v', s_suppkey, chr(10), '---', chr(10), 'Works with [[n', s_nationkey, '#Top]] and [[s', s_suppkey + 1, '|next]].', chr(10)) AS content FROM supplier""")
def page_render(t):
    """Frontmatter in the contract's order, whatever order it was read in."""
    return _pages(t).where("type = 'person'").mapInArrow(frontmatter.render_pages, "path string, content string")


@query(f"""WITH {_F} SELECT path, regexp_extract(path, '([^/]+)$', 1) AS file_name, sha256(content) AS item_key, regexp_extract(path, '^raw/inbox/([^/]+)/', 1) AS channel, regexp_extract(content, 'source: (\\w+)', 1) AS source,
  '2001-05-25 10:00:00' AS captured_at, 'inbox' AS state FROM f WHERE path LIKE 'raw/inbox/%'""")
def raw_inbox(t):
    return vault.inbox(t._spark, _root(t)).select("path", "file_name", "item_key", "channel", "source", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), "state")


def _channel_scan(name: str) -> None:
    def scan(t):
        return vault.inbox(t._spark, _root(t), name).select("path", "content")

    scan.__name__ = f"inbox_{name}"
    query(f"WITH {_F} SELECT path, content FROM f WHERE path LIKE 'raw/inbox/{name}/%'")(scan)


for _name in schemas.CHANNELS:
    _channel_scan(_name)


@query(f"WITH {_F} SELECT path, content, 'quarantine' AS state FROM f WHERE path LIKE 'raw/quarantine/%'")
def quarantine_scan(t):
    return vault.quarantine(t._spark, _root(t)).select("path", "content", "state")


@query(f"""WITH {_F} SELECT path, 'meetings' AS raw_class, 'meetings' AS channel, 2001 AS year, 1 AS month, 'filed' AS state FROM f WHERE path LIKE 'raw/meetings/%'""")
def dated_raw(t):
    return vault.located(vault.raw_items(t._spark, _root(t), "meetings")).select("path", "raw_class", "channel", "year", "month", "state")


@query(f"""WITH {_F} SELECT path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(content, chr(10))) AS text FROM f WHERE path LIKE 'raw/meetings/%'""")
def meeting_lines(t):
    return vault.lines(vault.raw_items(t._spark, _root(t), "meetings"))


@query(f"WITH {_F} SELECT path, length(content) AS length FROM f WHERE path LIKE 'raw/assets/%'")
def assets_scan(t):
    return vault.assets(t._spark, _root(t)).select("path", "length")


@query(f"WITH {_F} SELECT path, upper(content) AS content FROM f WHERE path LIKE 'raw/docs/%'")
def converted_docs(t):
    upper = lambda path, data: data.decode().upper()
    found = vault.converted(t._spark, f"{_root(t)}/raw/docs", upper, "*.bin")
    return found.select(vault.relative(t._spark, _root(t), F.col("path")).alias("path"), "content")


@query(f"WITH {_F} SELECT path FROM f WHERE path LIKE 'wiki/%' AND path NOT LIKE 'wiki/orgs/%' AND NOT regexp_matches(path, '/[^/]*7\\.md$')")
def search_excluded(t):
    return vault.excluded(_pages(t).select("path"), ["# orgs stay private", "orgs/", "*7.md"])


@query("SELECT 's' || s_suppkey AS src, 'works_at' AS edge, 'n' || s_nationkey AS dst, (10 + s_suppkey % 90) / 100 AS conf, 'queued' AS state FROM supplier")
def proposal_queue(t):
    return vault.proposals(t._spark, f"{_root(t)}/wiki/_inbox/edges.md")


@query("SELECT * FROM (VALUES ('node', 'person', NULL::VARCHAR, NULL::VARCHAR), ('node', 'org', NULL, NULL), ('edge', 'works_at', 'person', 'org')) v(kind, name, src_type, dst_type)")
def graph_schema_types(t):
    nodes, edges = vault.graph_schema(t._spark, f"{_root(t)}/schema/graph.ddl")
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("kind"), F.col("type").alias("name"), none.alias("src_type"), none.alias("dst_type")).unionAll(edges.select(F.lit("edge"), "edge", "src_type", "dst_type"))


@query("SELECT 'c' || n_nationkey AS channel, n_name AS author, 'hi ' || n_nationkey AS text, '2001-05-25 10:00:00' AS at FROM nation")
def chat_rows(t):
    return vault.chat_export(t._spark, f"{_root(t)}/exports/chats").select("channel", "author", "text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT 'emails' AS channel, 'm' AS source, n_name AS title, 'one' AS content FROM nation UNION ALL SELECT 'emails', '', '', 'two ' || n_nationkey FROM nation")
def provider_rows(t):
    t._spark.dataSource.register(ExportSource)
    rows = t._spark.read.format("provider_export").option("path", f"{_root(t)}/exports/mail").option("splitBytes", 50).load()
    return rows.fillna("").select("channel", "source", "title", "content")


# --- the graph of the pages -----------------------------------------------------------------------


@query("""SELECT 's' || s_suppkey AS src, 'works_at' AS edge, 'n' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT 'n' || n_nationkey, 'attended', 'r' || n_regionkey FROM nation""")
def pages_edges(t):
    return graph.project(_pages(t))[1]


@query("SELECT 's' || s_suppkey AS id, 'person' AS type FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'org' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'topic' FROM region")
def pages_nodes(t):
    return graph.project(_pages(t))[0]


@query("SELECT DISTINCT 's' || s_suppkey AS src, unnest(['n' || s_nationkey, 's' || (s_suppkey + 1)]) AS dst FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region")
def pages_links(t):
    return lint.links(_pages(t))


_WORKS = "w AS (SELECT 's' || s_suppkey AS p, 'n' || s_nationkey AS o FROM supplier WHERE s_suppkey % 5 <> 0), a AS (SELECT 'n' || n_nationkey AS o, 'r' || n_regionkey AS r FROM nation)"


@query(f"WITH {_WORKS} SELECT w.p AS n0, 'works_at' AS e1, w.o AS n1, 'attended' AS e2, a.r AS n2 FROM w JOIN a USING (o) WHERE a.r = 'r1'")
def graph_pattern(t):
    nodes, edges = graph.project(_pages(t))
    return graph.match("(person)-[works_at]->(org)-[attended|decided]->(topic:r1)", nodes, edges)


@query(f"WITH {_WORKS} SELECT 'r1' AS id, 0 AS hop UNION ALL SELECT DISTINCT o, 1 FROM a WHERE r = 'r1' UNION ALL SELECT DISTINCT p, 2 FROM w JOIN a USING (o) WHERE r = 'r1'")
def two_hops(t):
    return graph.hops(t._spark.createDataFrame([("r1",)], "id string"), graph.project(_pages(t))[1], 2)


@query("""WITH e AS (SELECT 's' || s_suppkey AS src, CASE WHEN s_suppkey % 7 = 0 THEN 'decided' WHEN s_suppkey % 7 = 1 THEN 'supplies' ELSE 'works_at' END AS edge, CASE WHEN s_suppkey % 11 = 0 THEN 'nowhere' ELSE 'n' || s_nationkey END AS dst FROM supplier)
SELECT 'unknown_edge' AS rule, src, edge, dst FROM e WHERE edge = 'supplies' UNION ALL SELECT 'wrong_end', src, edge, dst FROM e WHERE edge = 'decided' UNION ALL SELECT 'missing_page', src, edge, dst FROM e WHERE dst = 'nowhere'
UNION ALL SELECT 'unknown_type', 'r' || r_regionkey, 'area', NULL FROM region""")
def graph_validate(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kinds = lambda df, id_, kind: df.select(id_.alias("id"), F.lit(kind).alias("type"))
    nodes = kinds(t.supplier, key("s", "s_suppkey"), "person").unionAll(kinds(t.nation, key("n", "n_nationkey"), "org")).unionAll(kinds(t.region, key("r", "r_regionkey"), "area"))
    name = F.when(F.col("s_suppkey") % 7 == 0, "decided").when(F.col("s_suppkey") % 7 == 1, "supplies").otherwise("works_at")
    edges = t.supplier.select(key("s", "s_suppkey").alias("src"), name.alias("edge"), F.when(F.col("s_suppkey") % 11 == 0, "nowhere").otherwise(key("n", "s_nationkey")).alias("dst"))
    return graph.validate(nodes, edges, schemas.vocab_nodes(t._spark), schemas.vocab_edges(t._spark))


@query("""SELECT 'n' || n_nationkey AS slug, '["r' || n_regionkey || '"' || coalesce(string_agg(',"s' || s_suppkey || '"', '' ORDER BY 's' || s_suppkey), '') || ']' AS attended, CASE WHEN count(s_suppkey) > 0 THEN min('s' || s_suppkey) ELSE '' END AS superseded_by
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey""")
def promotion_lists(t):
    """Several confirmed targets of one edge in a page's other keys, and superseded_by in its column."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    confirmed = t.supplier.select(key("n", "s_nationkey").alias("src"), F.lit("attended").alias("edge"), key("s", "s_suppkey").alias("dst"))
    done = graph.into_rest(_pages(t).where("type = 'org'"), confirmed)
    done = graph.into_column(done, confirmed.withColumn("edge", F.lit("superseded_by")), "superseded_by")
    # A nation without suppliers keeps its list as it was read.
    return done.select("slug", F.replace(F.element_at("rest", F.lit("attended")), F.lit(", "), F.lit(",")).alias("attended"), F.coalesce("superseded_by", F.lit("")).alias("superseded_by"))


@query(f"""WITH {_F}, p AS (SELECT 's' || s_suppkey AS slug, 's' || (s_suppkey + 1) AS next, 'n' || s_nationkey AS org, s_suppkey AS k, CAST('2001-0' || (1 + s_suppkey % 7) || '-15' AS DATE) AS day FROM supplier),
linked AS (SELECT next AS slug FROM p UNION SELECT org FROM p UNION SELECT 'r' || r_regionkey FROM region), own AS (SELECT slug FROM p UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)
SELECT 'person_without_works_at' AS rule, slug, '' AS detail FROM p WHERE k % 5 = 0 UNION ALL SELECT 'orphan', slug, '' FROM own WHERE slug NOT IN (SELECT slug FROM linked)
UNION ALL SELECT 'stale', slug, strftime(day, '%Y-%m-%d') FROM p WHERE day < DATE '{AS_OF}' - INTERVAL 90 DAY UNION ALL SELECT 'never_verified', slug, '' FROM own WHERE slug NOT IN (SELECT slug FROM p)
UNION ALL SELECT 'dangling_link', slug, next FROM p WHERE next NOT IN (SELECT slug FROM own)""")
def lint_findings(t):
    return lint.lint(_pages(t), AS_OF).fillna("")


# --- ingest, upkeep and status --------------------------------------------------------------------


@query("""SELECT src, edge, dst, conf, 'queued' AS state FROM (SELECT DISTINCT 's' || s_suppkey AS src, 'attended' AS edge, 'n' || s_nationkey AS dst, 0.9::DOUBLE AS conf FROM supplier
UNION ALL SELECT 'sam' || s_suppkey, 'works_at', 'org' || s_nationkey, 0.6 FROM supplier UNION ALL SELECT 's' || s_suppkey || '.md', 'decided', 'keep-' || s_suppkey, 0.5 FROM supplier)""")
def edges_from_text(t):
    return ingest.propose_edges(vault.raw_items(t._spark, _root(t), "meetings"), "file_name", "content").withColumn("conf", F.col("conf").cast("double"))


@query("SELECT 's' || s_suppkey AS src, 'works_at' AS edge, 'n' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 2 = 1")
def proposals_new(t):
    found = vault.proposals(t._spark, f"{_root(t)}/wiki/_inbox/edges.md").select("src", "edge", "dst")
    return ingest.queue(found, found.where(F.substring("src", 2, 20).cast("long") % 2 == 0))


@query("SELECT 's' || (max(s_suppkey) + 1) AS slug, 'wiki/tofile/s' || (max(s_suppkey) + 1) || '.md' AS path FROM supplier")
def stub_paths(t):
    return ingest.stubs(lint.links(_pages(t)), _pages(t))


_TOLD = f"""i AS (SELECT s_suppkey AS k, 'raw/' || {_CHANNEL.format('s_suppkey')} || '/2001/05/i' || s_suppkey || '.md' AS final FROM supplier)"""


def _told(t) -> tuple[DataFrame, DataFrame]:
    """Items that each tell of one of ten new topics and of a supplier's page."""
    items = vault.inbox(t._spark, _root(t))
    k = F.regexp_extract("file_name", r"i(\d+)", 1).cast("long")
    slugs = F.explode(F.array(F.concat(F.lit("topic-"), (k % 10).cast("string")), F.concat(F.lit("s"), k.cast("string"))))
    return items, items.select("path", slugs.alias("slug"), F.concat(F.lit("told in "), "file_name").alias("bullet"))


@query(f"""WITH {_TOLD} SELECT 'b' AS batch_id, final AS source_path, 'wiki/tofile/topic-' || (k % 10) || '.md' AS path, 'create' AS op, '' AS before,
  concat('---', chr(10), 'type: tofile', chr(10), 'sources:', chr(10), '  - ', final, chr(10), '---', chr(10), chr(10), chr(10), '## Mentions', chr(10), '- told in i', k, '.md') AS after FROM i
UNION ALL SELECT 'b', final, 'wiki/people/s' || k || '.md', 'update', head || tail, concat(head, '  - ', final, chr(10), tail, chr(10), chr(10), '## Mentions', chr(10), '- told in i', k, '.md')
FROM (SELECT k, final, concat('---', chr(10), 'type: person', chr(10), 'last_verified: 2001-0', 1 + k % 7, '-15', chr(10), CASE WHEN k % 5 <> 0 THEN concat('works_at:', chr(10), '  - n', s_nationkey, chr(10)) ELSE '' END, 'sources:', chr(10), '  - raw/meetings/2001/01/s', k, '.md', chr(10)) AS head,
  concat('key: v', k, chr(10), '---', chr(10), 'Works with [[n', s_nationkey, '#Top]] and [[s', k + 1, '|next]].', chr(10)) AS tail FROM i JOIN supplier ON s_suppkey = k)""")
def fan_out_changes(t):
    """What each source by itself would do to the pages it tells of."""
    items, told = _told(t)
    return ingest.fan_out(items, told, _pages(t), "b").fillna("", ["before"])


@query(f"""WITH {_TOLD} SELECT 'wiki/tofile/topic-' || (k % 10) || '.md' AS path, 'create' AS op,
  concat('---', chr(10), 'type: tofile', chr(10), 'sources:', chr(10), string_agg('  - ' || final, chr(10) ORDER BY final), chr(10), '---', chr(10), chr(10), chr(10), '## Mentions', chr(10), string_agg('- told in i' || k || '.md', chr(10) ORDER BY final DESC)) AS after FROM i GROUP BY k % 10""")
def page_changes(t):
    """What all sources together do to a page."""
    items, told = _told(t)
    return ingest.fan_out(items, told, _pages(t), "b", by_source=False).where("op = 'create'").select("path", "op", "after")


@query(f"WITH {_TOLD} SELECT final AS path, 'raw/inbox/' || {_CHANNEL.format('k')} || '/i' || k || '.md' AS was, 'filed' AS state, 'b' AS batch_id FROM i")
def filed_items(t):
    return ingest.file_away(vault.inbox(t._spark, _root(t)), "b").select("path", "was", "state", "batch_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR trim(text) = '' OR text IS NULL OR contains(text, chr(65533)) THEN 'quarantine' ELSE 'inbox' END AS state FROM documents")
def split_valid(t):
    channel = F.when(F.col("doc_id") % 4 == 0, "elsewhere").otherwise("docs")
    good, bad = ingest.split_valid(t.documents.select("doc_id", F.col("text").alias("content"), channel.alias("channel"), F.lit("inbox").alias("state")))
    return good.unionByName(bad).select("doc_id", "state")


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def normalised_text(t):
    return t.conversations.select("conv_id", "turn", fn.normalised("text").alias("text"))


@query(f"SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')::INTEGER AS days FROM orders")
def age_days(t):
    return t.orders.select("o_orderkey", fn.age_days("o_orderdate", F.lit(AS_OF).cast("date")).alias("days"))


@query("SELECT doc_id, sha256(text) AS item_key FROM documents")
def content_keys(t):
    return t.documents.select("doc_id", fn.content_key("text").alias("item_key"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('a', chr(10), chr(10), '## Log', chr(10), '- ', p_name) WHEN 1 THEN concat('## Log', chr(10), '- ', p_name, chr(10), '- old', chr(10), '## End')
  ELSE concat('## Log', chr(10), '- ', p_name, chr(10), '## End', chr(10), '- ', p_name) END AS body FROM part""")
def bullets(t):
    """Without the heading, under it, and where the bullet is only in another section."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    body = F.when(k == 0, "a").when(k == 1, "## Log\n- old\n## End").otherwise(F.concat(F.lit("## Log\n## End\n- "), name))
    return t.part.select("p_partkey", fn.append_bullet(body, F.lit("Log"), name).alias("body"))


@query("""SELECT 'wiki/threads/worthless.md' AS path, concat('---', chr(10), 'type: thread', chr(10), '---', chr(10), '# worthless', chr(10), chr(10),
  string_agg(concat('- ', turn, ' (raw, c', conv_id, '/', turn, '): ', trim(regexp_replace(text, '\\s+', ' ', 'g'))), chr(10) ORDER BY turn, 'c' || conv_id || '/' || turn), chr(10)) AS content FROM conversations WHERE contains(lower(text), 'worthless') HAVING count(*) > 0""")
def thread_page(t):
    raw = t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"), "text", F.col("turn").alias("at"))
    return maintenance.thread_page(maintenance.thread(raw, raw.where("false"), "worthless"), "worthless")


@query("""SELECT 'wiki/_maps/people.md' AS path, '- [[s' || s_suppkey || ']]' AS text FROM supplier UNION ALL SELECT 'wiki/_maps/orgs.md', '- [[n' || n_nationkey || ']]' FROM nation UNION ALL SELECT 'wiki/_maps/topics.md', '- [[r' || r_regionkey || ']]' FROM region""")
def map_lines(t):
    return maintenance.maps(_pages(t))


@query("""SELECT concat('# Overview', chr(10), chr(10), '## Pages', chr(10), chr(10), '- org: ', (SELECT count(*) FROM nation), chr(10), '- person: ', (SELECT count(*) FROM supplier), chr(10), '- topic: ', (SELECT count(*) FROM region), chr(10), chr(10),
  '## Lint debt', chr(10), chr(10), '- person_without_works_at: ', (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0), chr(10)) AS content""")
def overview_page(t):
    text = status.overview(status.page_counts(_pages(t)), lint.debt(lint.invariants(_pages(t))))
    return t._spark.createDataFrame([(text,)], "content string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey % 2 = 1")
def versioned_table(t):
    """Two commits: one replaces a directory of the table, the other adds one; what nobody committed isn't seen."""
    store = Store(t._spark, fresh(t._spark, "store"))
    rows = t.nation.select("n_nationkey", "n_name")
    even = {"parts": [store.write(rows.where("n_nationkey % 2 = 0"), "nations")], "at": 1}
    store.commit(0, {"nations": {"parts": [store.write(rows, "nations")], "at": 1}})
    store.commit(1, {"nations": even})
    odd = store.write(rows.where("n_nationkey % 2 = 1").withColumn("n_name", F.upper("n_name")), "nations")
    store.write(rows, "nations")
    store.commit(2, {"nations": {"parts": [*even["parts"], odd], "at": 3}})
    return store.read(store.latest()[1]["nations"]["parts"], "n_nationkey int, n_name string")


# --- a day of commands ----------------------------------------------------------------------------


def _day(t) -> dict[str, DataFrame]:
    """The tables of a vault after two collects of the same items, an ingest, a second batch and its undoing."""

    def make():
        v = Vault(t._spark, fresh(t._spark, "day"))
        v.init()
        at = F.lit(datetime.datetime(2001, 5, 25)).cast("timestamp")
        key = F.col("s_suppkey").cast("string")
        channel = F.element_at(F.array(*(F.lit(c) for c in schemas.CHANNELS)), (F.col("s_suppkey") % 6 + 1).cast("int"))
        items = t.supplier.select(F.concat(F.lit("i"), key, F.lit(".md")).alias("file_name"), channel.alias("channel"), F.lit("s").alias("source"), at.alias("captured_at"), F.concat(F.lit("on [[topic-"), (F.col("s_suppkey") % 10).cast("string"), F.lit("]] by "), key).alias("content"))
        first, again = v.collect(items), v.collect(items)
        out = {"first": first, "again": again, "inbox": v.table("inbox"), "diff": v.ingest("b1", approve=True), "pages": v.table("pages"), "filed": v.table("filed")}
        second = t.nation.select(F.concat(F.lit("i"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("file_name"), F.lit("emails").alias("channel"), F.lit("n").alias("source"), at.alias("captured_at"), F.concat(F.lit("on [[late]] by nation "), F.col("n_nationkey").cast("string")).alias("content"))
        v.collect(second)
        v.ingest("b2", approve=True)
        out["both"] = v.table("pages")
        v.undo_ingest("b2")
        return out | {"undone": v.table("pages"), "undone_raw": v.table("raw"), "log": v.table("log")}

    return _once(t, "day", make)


_ITEMS = f"it AS (SELECT s_suppkey AS k, {_CHANNEL.format('s_suppkey')} AS channel, 'on [[topic-' || (s_suppkey % 10) || ']] by ' || s_suppkey AS content FROM supplier)"


@query(f"WITH {_ITEMS} SELECT 'first' AS run, channel, count(*) AS new, 0::BIGINT AS duplicates FROM it GROUP BY channel UNION ALL SELECT 'again', channel, 0, count(*) FROM it GROUP BY channel")
def vault_collect(t):
    run = lambda name: _day(t)[name].withColumn("run", F.lit(name))
    return run("first").unionByName(run("again")).select("run", "channel", "new", "duplicates")


@query(f"WITH {_ITEMS} SELECT 'raw/inbox/' || channel || '/i' || k || '.md' AS path, sha256(content) AS item_key, content, 'inbox' AS state FROM it")
def vault_inbox(t):
    return _day(t)["inbox"].select("path", "item_key", "content", "state")


@query(f"""WITH {_ITEMS} SELECT 'topic-' || (k % 10) AS slug, 'tofile' AS type, string_agg('raw/' || channel || '/2001/05/i' || k || '.md', ',' ORDER BY 'raw/' || channel || '/2001/05/i' || k || '.md') AS sources FROM it GROUP BY k % 10""")
def vault_ingest(t):
    return _day(t)["pages"].select("slug", "type", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {_ITEMS} SELECT 'raw/' || channel || '/2001/05/i' || k || '.md' AS source_path, 'wiki/tofile/topic-' || (k % 10) || '.md' AS path, 'create' AS op, 1::BIGINT AS n, true AS told FROM it""")
def vault_diffs(t):
    told = F.contains("diff", F.concat(F.lit("+- mentioned in "), F.element_at(F.split("source_path", "/"), -1)))
    return _day(t)["diff"].select("source_path", "path", "op", "n", told.alias("told"))


@query(f"WITH {_ITEMS} SELECT 'after b1' AS at, 'topic-' || (k % 10) AS slug FROM it GROUP BY k % 10 UNION ALL SELECT 'after b2', 'topic-' || (k % 10) FROM it GROUP BY k % 10 UNION ALL SELECT 'after b2', 'late' UNION ALL SELECT 'undone', 'topic-' || (k % 10) FROM it GROUP BY k % 10")
def vault_undo_pages(t):
    day = _day(t)
    return day["pages"].select(F.lit("after b1").alias("at"), "slug").unionAll(day["both"].select(F.lit("after b2"), "slug")).unionAll(day["undone"].select(F.lit("undone"), "slug"))


@query(f"WITH {_ITEMS} SELECT 'raw/' || channel || '/2001/05/i' || k || '.md' AS path, 'filed' AS state FROM it UNION ALL SELECT 'raw/inbox/emails/i' || n_nationkey || CASE WHEN n_nationkey IN (SELECT k FROM it WHERE channel = 'emails') THEN '-' || left(sha256('on [[late]] by nation ' || n_nationkey), 12) ELSE '' END || '.md', 'inbox' FROM nation")
def vault_undo_items(t):
    """Files of the same name from another channel stay filed; those whose channel has the name already have another."""
    return _day(t)["undone_raw"].select("path", "state")


@query(f"""WITH {_ITEMS} SELECT 'ingest' AS skill, 'b1' AS batch_id, channel, 'file' AS op, count(*) AS n FROM it GROUP BY channel UNION ALL SELECT 'ingest', 'b2', 'emails', 'file', count(*) FROM nation UNION ALL SELECT 'undo', 'b2', 'emails', 'undo', count(*) FROM nation
UNION ALL SELECT 'collect', 'collect', channel, 'collect', 2 + (channel = 'emails')::INTEGER FROM it GROUP BY channel""")
def vault_log(t):
    return _day(t)["log"].groupBy("skill", "batch_id", "channel", "op").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 's' || s_suppkey AS id FROM supplier WHERE s_suppkey IN (1, 3)")
def question_seeds(t):
    return retrieval.recognise("What do S1 and s3 do?", retrieval.aliases_of(_pages(t)))
