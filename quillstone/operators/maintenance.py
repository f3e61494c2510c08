"""Upkeep of a vault: rename, merge, link, archive, refactor, compile, thread, scaffold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import slugify, type_dir, wikilinks
from quillstone.operators.graph import follow, small
from quillstone.schemas import ARCHIVE, EDGE_KEYS, RAW_CLASSES, SERVICE_DIRS, TYPE_TO_DIR


def rename(rows: DataFrame, renames: DataFrame, *columns: str) -> DataFrame:
    """`rows` with slugs in `columns` (texts or lists of texts) replaced by renames (old, new).

    A list is changed in its row, by the renames as a map if they are few enough to be broadcast, else by way of
    the rows' own values: equal lists are renamed once and found again by what they were.
    """
    pairs = renames.select("old", "new")
    for c in columns:
        if dict(rows.dtypes)[c].startswith("array"):
            lists = rows.select(F.col(c).alias("_was")).where("_was is not null and size(_was) > 0").distinct()
            each = lists.select("_was", F.posexplode("_was").alias("_p", "old")).join(small(pairs), "old", "left")
            now = each.groupBy("_was").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("new", "old").alias("v")))), lambda x: x["v"]).alias("_now"))
            rows = rows.join(now, F.col(c) == F.col("_was"), "left").withColumn(c, F.coalesce("_now", c)).select(rows.columns)
        else:
            rows = rows.join(small(pairs).withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).select(rows.columns)
    return rows


def rename_links(rows: DataFrame, old: str, new: str, body: str = "body") -> DataFrame:
    """Wikilinks to `old` in bodies lead to `new`; labels and headings stay."""
    import re

    return rows.withColumn(body, F.regexp_replace(body, rf"\[\[\s*{re.escape(old)}\s*(?=[\]|#])", f"[[{new}"))


def redirected(pages: DataFrame, renames: DataFrame, edge_keys: tuple[str, ...] = EDGE_KEYS) -> DataFrame:
    """Pages (schemas.PAGES) in which everything that names a slug names its new one: lists, superseded_by, edges among the other keys, links in bodies.

    renames: old, new, with one row per old. A page's own slug stays. What a page names is joined with the renames, so pages that name none
    of them are left as they are, and no page is joined with more rows than it has names.
    """
    out = rename(pages, renames, "superseded_by", "works_at", "contradicts")
    for c in ("works_at", "contradicts"):
        out = out.withColumn(c, F.array_distinct(c))
    listed = F.col("value").startswith("[")
    values = F.when(listed, F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).otherwise(F.array("value"))
    kept = out.select("slug", F.explode("rest")).where(F.col("key").isin(*edge_keys)).select("slug", "key", listed.alias("listed"), F.posexplode(values).alias("i", "old"))
    named = kept.join(small(renames.select("old", "new")), "old", "left")
    keys = named.groupBy("slug", "key").agg(F.max("listed").alias("listed"), F.max(F.col("new").isNotNull()).alias("hit"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "old").alias("v")))).alias("v")).where("hit")
    now = F.array_distinct(F.transform("v", lambda x: x["v"]))
    keys = keys.select("slug", F.struct("key", F.when(F.col("listed"), F.to_json(now)).otherwise(now[0]).alias("value")).alias("e")).groupBy("slug").agg(F.map_from_entries(F.collect_list("e")).alias("_rest"))
    other = lambda: F.map_filter("rest", lambda k, v: ~F.map_contains_key("_rest", k))
    out = out.join(keys, "slug", "left").withColumn("rest", F.when(F.col("_rest").isNull(), F.col("rest")).otherwise(F.map_concat(other(), "_rest"))).select(pages.columns)
    links = out.select("slug", F.explode(F.array_distinct(wikilinks("body"))).alias("old")).join(small(renames.select("old", "new")), "old")
    links = links.groupBy("slug").agg(F.collect_list(F.struct("old", "new")).alias("_links"))
    one = lambda body, x: F.regexp_replace(body, F.concat(F.lit(r"\[\[\s*\Q"), x["old"], F.lit(r"\E\s*(?=[\]|#])")), F.concat(F.lit("[["), x["new"]))
    return out.join(links, "slug", "left").withColumn("body", F.when(F.col("_links").isNull(), F.col("body")).otherwise(F.aggregate("_links", F.col("body"), one))).select(pages.columns)


def merge(pages: DataFrame, identity: str, slug: str, *lists: str) -> DataFrame:
    """One row per identity: the smallest slug as keeper, the others, and each list column folded to its sorted distinct values."""
    own = pages.where(F.col(identity).isNotNull())
    fold = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    out = own.groupBy(identity).agg(F.min(slug).alias("keeper"), F.count("*").alias("n"), *fold)
    return out


def link_candidates(stubs: DataFrame, canonical: DataFrame, distance: int = 2) -> DataFrame:
    """(stub, slug, distance): stubs within an edit distance of a canonical slug, each pair once and none lost.

    Names within `distance` edits have a text in common that leaves out at most `distance` characters of each, so
    they are joined by all such texts.
    """
    left_out = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    shorter = lambda x: F.when(F.length(x) > 0, left_out(x)).otherwise(F.array().cast("array<string>"))

    def keys(c: str):
        found = F.array(F.col(c))
        for _ in range(distance):
            found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
        return F.explode(found).alias("_k")

    a, b = stubs.select(F.col("slug").alias("stub")).distinct(), canonical.select("slug").distinct()
    pairs = a.select("stub", keys("stub")).join(b.select("slug", keys("slug")), "_k").where("stub <> slug").select("stub", "slug").distinct()
    return pairs.withColumn("distance", F.levenshtein("stub", "slug", distance)).where("distance >= 0")


def archive(pages: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with the stale ones moved to the archive, where their slug is archive/<slug>; redirects from_slug -> to_slug)."""
    gone = stale.select("slug").distinct().withColumn("_gone", F.lit(True))
    there = pages.join(gone, "slug", "left")
    moved = there.withColumns({"path": F.when(F.col("_gone"), F.concat(F.lit(ARCHIVE), "slug", F.lit(".md"))).otherwise(F.col("path")), "slug": F.when(F.col("_gone"), F.concat(F.lit("archive/"), "slug")).otherwise(F.col("slug"))}).select(pages.columns)
    return moved, gone.select(F.col("slug").alias("from_slug"), F.concat(F.lit("archive/"), "slug").alias("to_slug"))


def resolve(rows: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """Slugs in `column` after following redirects, however many; those whose redirects run into a cycle stay as they are."""
    ends = follow(redirects.select(F.col("from_slug").alias("src"), F.col("to_slug").alias("dst"))).where("not cyclic")
    return rows.join(ends.select(F.col("start").alias(column), F.col("end").alias("_end")), column, "left").withColumn(column, F.coalesce("_end", column)).select(rows.columns)


def sections(pages: DataFrame, slug: str = "slug", body: str = "body") -> DataFrame:
    """(slug, ord, heading, text): a body cut before each second-level heading; ord 0 has no heading."""
    part = F.posexplode(F.split(F.concat(F.lit("\n"), body), r"\n(?=## )")).alias("ord", "chunk")
    head = F.nullif(F.trim(F.regexp_extract("chunk", r"^## ([^\n]*)", 1)), F.lit(""))
    return pages.select(F.col(slug).alias("slug"), part).select("slug", "ord", head.alias("heading"), F.trim(F.regexp_replace("chunk", r"^(?:\n|## [^\n]*\n?)", "")).alias("text"))


def split_bloated(pages: DataFrame, longest: int, slug: str = "slug", body: str = "body") -> DataFrame:
    """Sections of the pages whose body is longer than `longest`, each to become a page of its own."""
    return sections(pages.where(F.length(body) > longest), slug, body)


def split_pages(pages: DataFrame, longest: int) -> DataFrame:
    """Bloated pages and what they become: each section a page of its own, and the page with its preamble and links to them.

    A section's slug is the page's and its heading's; of equal headings the later ones have their number after it.
    """
    parts = sections(pages.where(F.length("body") > longest)).withColumnRenamed("slug", "_of").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    name = F.concat_ws("-", "_of", slugify("heading"))
    again = F.row_number().over(Window.partitionBy("_of", name).orderBy("ord"))  # within a page
    parts = parts.withColumn("_name", F.when(F.col("ord") > 0, F.when(again > 1, F.concat_ws("-", name, again.cast("string"))).otherwise(name)))
    heads = parts.groupBy("_of").agg(
        F.max(F.when(F.col("ord") == 0, F.col("text"))).alias("_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") > 0, F.struct("ord", "_name")))), lambda x: F.concat(F.lit("- [["), x["_name"], F.lit("]]"))), "\n").alias("_list"),
    )
    heads = pages.join(heads, F.col("slug") == F.col("_of")).withColumn("body", F.concat_ws("\n\n", F.nullif("_text", F.lit("")), F.nullif("_list", F.lit("")))).select(pages.columns)
    own = pages.join(parts.where("ord > 0"), F.col("slug") == F.col("_of")).withColumn("body", F.col("text"))
    own = own.withColumn("path", F.concat(F.regexp_replace("path", r"[^/]+$", ""), F.col("_name"), F.lit(".md"))).withColumn("slug", F.col("_name")).withColumn("file_name", F.concat("_name", F.lit(".md")))
    kept = ("slug", "type", "path", "file_name", "status", "created", "last_verified", "sources", "body")
    own = own.select(*(F.col(c) if c in kept else F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in pages.columns))
    return heads.unionByName(own)


def maps(pages: DataFrame) -> DataFrame:
    """(path, line, text): the lines of a map page per type, that is links to its pages by slug; a row per line, as types may have many."""
    where = F.concat(F.lit("wiki/_maps/"), type_dir("type"), F.lit(".md"))
    rows = pages.where(type_dir("type").isNotNull()).select(where.alias("path"), F.concat(F.lit("- [["), "slug", F.lit("]]")).alias("text"))
    return rows.orderBy("path", "text")


def scoped(raw: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """The raw rows that a compile run rebuilds from."""
    return raw.join(scope.select(key).distinct(), key, "left_semi")


def thread(raw: DataFrame, wiki: DataFrame, topic: str, text: str = "text", at: str = "at") -> DataFrame:
    """A topic's timeline over raw and wiki rows, in order of time and path."""
    rows = raw.withColumn("layer", F.lit("raw")).unionByName(wiki.withColumn("layer", F.lit("wiki")), allowMissingColumns=True)
    return rows.where(F.contains(F.lower(text), F.lit(topic.lower()))).orderBy(at, "path")


def thread_page(timeline: DataFrame, topic: str) -> DataFrame:
    """(path, content) of a topic's thread page: one line for each entry, in their order. A page is one text, however many entries it has."""
    line = F.concat(F.lit("- "), F.col("at").cast("string"), F.lit(" ("), "layer", F.lit(", "), "path", F.lit("): "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    entries = F.array_sort(F.collect_list(F.struct("at", "path", line.alias("line"))))
    body = F.concat(F.lit(f"---\ntype: thread\n---\n# {topic}\n\n"), F.array_join(F.transform(entries, lambda x: x["line"]), "\n"), F.lit("\n"))
    return timeline.agg(F.count("*").alias("n"), body.alias("content")).where("n > 0").select(F.concat(F.lit("wiki/threads/"), slugify(F.lit(topic)), F.lit(".md")).alias("path"), "content")


def narrative(timeline: DataFrame, topic: str) -> str:
    """A thread page as Markdown, from all entries of a timeline in its order; the page is one string on the driver."""
    return "\n".join([f"# {topic}", "", *(f"- {r['at']} ({r['layer']}, {r['path']}): {r['text']}" for r in timeline.toLocalIterator())])


def scaffold(root: str, contract: str = "CONTRACT.md") -> list[str]:
    """Create an empty vault's directories; refuses a directory that has a contract file already."""
    import os

    if os.path.exists(os.path.join(root, contract)):
        raise FileExistsError(f"{root} is a vault already")
    names = [f"raw/inbox/{c}" for c in ("journal", "meetings", "emails", "chats", "clippings", "docs")]
    names += [f"raw/{c}" for c in RAW_CLASSES] + [f"wiki/{d}" for d in (*TYPE_TO_DIR.values(), *SERVICE_DIRS)]
    for n in names:
        os.makedirs(os.path.join(root, n), exist_ok=True)
    return names
