"""The graph derived from page frontmatter: project, validate, expand, promote, follow chains, export."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.paths import walks
from quillstone.schemas import EDGE_KEYS
from quillstone.shared import stash, told_apart, unstash

#: A vocabulary or a rename map above this many rows is joined by shuffle instead of broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it is checked to have at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def project(pages: DataFrame, edge_keys: tuple[str, ...] = EDGE_KEYS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), a pure function of the pages: contract columns and other keys that name edges."""
    nodes = pages.select(F.col("slug").alias("id"), "type")
    named = [F.struct(F.lit(k).alias("edge"), (F.col(k) if dict(pages.dtypes)[k].startswith("array") else F.array(k)).alias("dsts")) for k in edge_keys if k in pages.columns]
    rest = [k for k in edge_keys if k not in pages.columns]
    found = F.array(*named)
    if rest and "rest" in pages.columns:
        value = lambda k: F.element_at("rest", F.lit(k))
        lists = lambda k: F.coalesce(F.from_json(value(k), "array<string>"), F.array(value(k)))
        found = F.concat(found, F.array(*(F.struct(F.lit(k).alias("edge"), F.when(value(k).startswith("["), lists(k)).otherwise(F.array(value(k))).alias("dsts")) for k in rest)))
    rows = pages.select(F.col("slug").alias("src"), F.explode(found).alias("e")).select("src", "e.edge", F.explode("e.dsts").alias("dst"))
    return nodes, rows.where("dst is not null").distinct()


def foreign_key_edges(tables: list[tuple[DataFrame, Column, str, Column]]) -> DataFrame:
    """Typed edges (src, edge, dst) from tables: (rows, source id, edge name, target id) each."""
    return reduce(DataFrame.unionAll, [rows.select(src.alias("src"), F.lit(edge).alias("edge"), dst.alias("dst")) for rows, src, edge, dst in tables])


def undeclared(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges whose name isn't in the closed vocabulary."""
    return edges.join(small(vocabulary.select("edge").distinct()), "edge", "left_anti").select(edges.columns)


def validate(nodes: DataFrame, edges: DataFrame, vocab_nodes: DataFrame, vocab_edges: DataFrame) -> DataFrame:
    """(rule, src, edge, dst): unknown node types, unknown edge names, ends of the wrong type, ends that aren't pages."""
    kinds = nodes.select("id", "type")
    ends = edges.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("st")), "src", "left").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst", "left")
    typed = ends.join(small(vocab_edges), "edge")
    wrong = typed.where("(src_type is not null and st is not null and st <> src_type) or (dst_type is not null and dt is not null and dt <> dst_type)")
    tag = lambda df, rule: df.select(F.lit(rule).alias("rule"), "src", "edge", "dst")
    bad_nodes = nodes.join(small(vocab_nodes.select("type")), "type", "left_anti").select(F.lit("unknown_type").alias("rule"), F.col("id").alias("src"), F.col("type").alias("edge"), F.lit(None).cast("string").alias("dst"))
    return tag(undeclared(edges, vocab_edges), "unknown_edge").unionByName(tag(wrong, "wrong_end")).unionByName(tag(ends.where("st is null or dt is null"), "missing_page")).unionByName(bad_nodes)


def expand(seeds: DataFrame, edges: DataFrame, edge_names: list[str] | None = None) -> DataFrame:
    """(id, edge, via): neighbours of seeds (id) one hop along the named edges, in both directions."""
    if edge_names:
        edges = edges.where(F.col("edge").isin(*edge_names))
    both = edges.select(F.col("src").alias("via"), "edge", F.col("dst").alias("id")).unionAll(edges.select(F.col("dst").alias("via"), "edge", F.col("src").alias("id")))
    return both.join(seeds.select(F.col("id").alias("via")).distinct(), "via").select("id", "edge", "via").distinct()


def hops(seeds: DataFrame, edges: DataFrame, n: int, edge_names: list[str] | None = None) -> DataFrame:
    """(id, hop): what seeds (id) reach in at most `n` hops, with the least hop; n is small and fixed in the plan."""
    reached = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = reached
    for hop in range(1, n + 1):
        front = expand(front, edges, edge_names).select("id").distinct().join(reached, "id", "left_anti").select("id", F.lit(hop).alias("hop"))
        reached = reached.unionAll(front)
    return reached


def promote(pages_edges: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges of the frontmatter after review: those there, and proposals whose decision is 'confirm'.

    decisions: src, edge, dst, decision. A proposal without one stays queued.
    """
    keys = ["src", "edge", "dst"]
    confirmed = proposals.join(decisions.where("decision = 'confirm'").select(*keys), keys, "left_semi").select(*keys)
    return pages_edges.select(*keys).unionAll(confirmed).distinct()


def into_frontmatter(pages: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Pages with the confirmed edges of one name merged into that list column; values already there stay first."""
    new = confirmed.where(F.col("edge") == key).groupBy(F.col("src").alias("slug")).agg(F.array_sort(F.collect_set("dst")).alias("_new"))
    merged = F.when(F.col("_new").isNotNull(), F.array_union(F.coalesce(key, F.array().cast("array<string>")), "_new")).otherwise(F.col(key))
    return pages.join(new, "slug", "left").withColumn(key, merged).select(pages.columns)


def into_rest(pages: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Pages with confirmed edges of any names merged into `rest`: a list of targets per name, as JSON; those already there stay first."""
    lists = confirmed.groupBy(F.col("src").alias("slug"), "edge").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))
    new = lists.groupBy("slug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge", "dsts")))).alias("_new"))
    there = lambda v: F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    rest = F.coalesce("rest", F.create_map().cast("map<string,string>"))
    merged = F.map_zip_with(rest, "_new", lambda k, v, n: F.when(n.isNull(), v).otherwise(F.to_json(F.array_union(there(v), n))))
    return pages.join(new, "slug", "left").withColumn("rest", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("rest"))).select(pages.columns)


def into_column(pages: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """Pages with a confirmed edge of one name in that scalar column, in place of what is there (of several the first by name)."""
    new = confirmed.where(F.col("edge") == key).groupBy(F.col("src").alias("slug")).agg(F.min("dst").alias("_new"))
    return pages.join(new, "slug", "left").withColumn(key, F.coalesce("_new", key)).select(pages.columns)


def follow(steps: DataFrame) -> DataFrame:
    """(start, end, hops, cyclic) of chains (src, dst) of any length, by joins that double the hops until none is left to follow.

    Redirects and superseded_by: a node has one step (of several the least dst). Chains that run into a cycle have
    cyclic set and no end and hops. Rounds grow with the logarithm of the longest chain: in each, at least the open
    chain nearest its end closes, unless all that are open are cyclic.
    """
    at, left = stash(steps.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst")).withColumn("hops", F.lit(1)), "steps"), -1
    while True:
        goes_on = at.select(F.col("src").alias("dst"), F.col("dst").alias("_next"), F.col("hops").alias("_more"))
        moved = at.join(goes_on, "dst", "left").select("src", F.coalesce("_next", "dst").alias("dst"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("open"))
        last, at = at, stash(moved, "steps")
        unstash(last)
        n = at.where("open").count()
        if n in (0, left):
            end = lambda c: F.when(~F.col("open"), F.col(c))
            return at.select(F.col("src").alias("start"), end("dst").alias("end"), end("hops").alias("hops"), F.col("open").alias("cyclic"))
        left, at = n, at.drop("open")


_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*([^()\s]+))?\s*\)")
_STEP = re.compile(r"(<)?-\s*\[\s*([\w|]*)\s*(\*\s*\d*\s*(?:\.\.\s*\d*)?)?\s*\]\s*-(>)?")


def _repeated(names: str, stars: str, left: bool, right: bool) -> str:
    """The expression of `paths` for a step with a star, such as [part_of|lives_in*1..4]."""
    least, dots, most = re.sub(r"[\s*]", "", stars).partition("..")
    counts = f"{{{least or 1},{most}}}" if dots or not least else f"{{{least}}}"
    ways = ["", "^"] if left == right else ["^"] if left else [""]
    return "(" + "|".join(w + n for n in (names.split("|") if names else ["."]) for w in ways) + ")" + counts


def match(pattern: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths through the graph that a pattern describes: a column n0, n1, ... per node and e1, e2, ... per edge.

    A pattern is nodes joined by edges: (person)-[works_at]->(org)<-[works_at|advises]-(:mona-reed). A node may name a
    type, an id after a colon, or neither; an edge may name alternatives, or none for any, and leads right, left, or, as -[..]-,
    either way. A node that a path visits twice counts as often. A star stands for several edges, (ann)-[knows|part_of*1..4]->():
    *2 are two, *2.. two or more, *..3 up to three, * one or more. Such a step finds each two nodes once, and its e is the number of
    edges of the shortest walk between them; it is followed from its right end if only that one names an id.
    """
    at, parts, text = 0, [], pattern.strip()
    while at < len(text):
        m = (_STEP if len(parts) % 2 else _NODE).match(text, at)
        if not m:
            raise ValueError(f"can't read the pattern at {text[at:]!r}")
        parts.append(m)
        at = re.compile(r"\s*").match(text, m.end()).end()
    if len(parts) % 2 == 0:
        raise ValueError("a pattern begins and ends with a node")

    def node(k: int) -> DataFrame:
        kind, id_ = parts[2 * k].groups()
        own = nodes.where(F.col("type") == kind) if kind else nodes
        return told_apart((own.where(F.col("id") == id_) if id_ else own).select(F.col("id").alias(f"n{k}")))

    out = node(0)
    for k in range(1, len(parts) // 2 + 1):
        left, names, stars, right = parts[2 * k - 1].groups()
        if stars:
            back = bool(parts[2 * k][2]) and not parts[2 * k - 2][2]
            a, b = (k, k - 1) if back else (k - 1, k)
            seeds = (node(k) if back else out).select(F.col(f"n{a}").alias("id"))
            found = walks(_repeated(names, stars, bool(right if back else left), bool(left if back else right)), edges, seeds)
            out = out.join(found.select(F.col("start").alias(f"n{a}"), F.col("hops").alias(f"e{k}"), F.col("node").alias(f"n{b}")), f"n{k - 1}").join(node(k), f"n{k}")
            continue
        own = edges.where(F.col("edge").isin(*names.split("|"))) if names else edges
        ways = {"src": "dst"} if right and not left else {"dst": "src"} if left and not right else {"src": "dst", "dst": "src"}
        step = reduce(DataFrame.unionAll, [own.select(F.col(a).alias(f"n{k - 1}"), F.col("edge").alias(f"e{k}"), F.col(b).alias(f"n{k}")) for a, b in ways.items()]).distinct()
        out = out.join(step, f"n{k - 1}").join(node(k), f"n{k}")
    return out.select(*(c for k in range(len(parts) // 2 + 1) for c in ([f"e{k}"] if k else []) + [f"n{k}"]))


def canvas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node and edge, for a canvas file."""
    n = nodes.select(F.to_json(F.struct(F.col("id"), F.lit("file").alias("type"), F.col("type").alias("label"))).alias("json"))
    e = edges.select(F.to_json(F.struct(F.concat_ws("-", "src", "edge", "dst").alias("id"), F.col("src").alias("fromNode"), F.col("dst").alias("toNode"), F.col("edge").alias("label"))).alias("json"))
    return n.unionAll(e)
