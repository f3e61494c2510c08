"""Collect and ingest: skip what is known, classify, route, fan out, show as changes, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import frontmatter
from quillstone.functions.text import append_bullets, dated_path, slugify, type_dir
from quillstone.schemas import CHANNELS
from quillstone.shared import stash


def unseen(items: DataFrame, known: DataFrame, key: str = "item_key") -> DataFrame:
    """Items whose key isn't known, once each (the smallest path): running it again adds nothing."""
    return items.join(known.select(key), key, "left_anti")


def keep_first(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the smallest `order`; min_by aggregates on the map side, no sort of the group."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(items.columns)


def named_apart(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items whose file name no other of their channel has: where it is taken, by a known item or by a smaller key, the key's beginning comes after it."""
    same = lambda a, b: a["channel"].eqNullSafe(b["channel"]) & a["file_name"].eqNullSafe(b["file_name"])
    first = items.groupBy("channel", "file_name").agg(F.min("item_key").alias("_first"))
    taken = known.select("channel", "file_name").distinct().withColumn("_taken", F.lit(True))
    rows = items.join(first, same(items, first)).select(items["*"], "_first")
    rows = rows.join(taken, same(rows, taken), "left").select(rows["*"], "_taken")
    parts = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 2)
    apart = F.concat(parts[0], F.lit("-"), F.substring("item_key", 1, 12), parts[1])
    return rows.withColumn("file_name", F.when(F.coalesce("_taken", F.lit(False)) | (F.col("item_key") != F.col("_first")), apart).otherwise(F.col("file_name"))).select(items.columns)


def collect_report(items: DataFrame, known: DataFrame, key: str = "item_key", by: str = "channel") -> DataFrame:
    """(channel, new, duplicates): items against what is there."""
    marked = items.join(known.select(key, F.lit(1).alias("_known")).distinct(), key, "left")
    return marked.groupBy(by).agg(F.count(F.when(F.col("_known").isNull(), 1)).alias("new"), F.count("_known").alias("duplicates"))


def split_valid(items: DataFrame, channels: tuple[str, ...] = CHANNELS) -> tuple[DataFrame, DataFrame]:
    """(items to ingest, items to quarantine): without text, without a known channel or with broken characters."""
    bad = F.coalesce(F.trim("content") == "", F.lit(True)) | ~F.coalesce(F.col("channel").isin(*channels), F.lit(False)) | F.coalesce(F.contains("content", F.lit("\ufffd")), F.lit(False))
    marked = items.withColumn("_bad", bad)
    return marked.where("not _bad").drop("_bad"), marked.where("_bad").drop("_bad").withColumn("state", F.lit("quarantine"))


def file_away(items: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Ingested items at their final, dated path, with their batch and the path they had; the content, hence the key, stays as it is."""
    moved = items.withColumn("was", F.col("path")) if "was" in items.columns else items
    moved = moved.withColumn("batch_id", F.lit(batch_id).cast("string")) if "batch_id" in items.columns else moved
    return moved.withColumn("path", dated_path("channel", "captured_at", "file_name")).withColumn("state", F.lit("filed"))


def classify(channel: Column, text: Column) -> Column:
    """Page type that an item is about: by channel, then by what its text says."""
    says = lambda pattern: text.rlike(pattern)
    return (
        F.when(channel == "meetings", "meeting")
        .when(says(r"(?i)\b(?:we|was|were|have) decided\b|\bdecision:"), "decision")
        .when(channel.isin("clippings", "docs"), "source")
        .when(says(r"(?i)\bproject\b"), "project")
        .otherwise("topic")
    )


def route(items: DataFrame, channel: str = "channel", text: str = "content") -> DataFrame:
    """With type and the directory of its page."""
    kind = classify(F.col(channel), F.col(text))
    return items.withColumn("type", kind).withColumn("dir", type_dir(kind))


_EDGE = r"\(([^()]+)\)\s*--([A-Za-z_]+)-->\s*\(([^()]+)\)"


def propose_edges(rows: DataFrame, id_: str = "slug", text: str = "body") -> DataFrame:
    """(src, edge, dst, conf, state) that texts suggest: explicit arrows (0.9), 'X works at Y' (0.6), 'decided to' after a meeting's name (0.5)."""
    arrow = [F.regexp_extract_all(F.col(text), F.lit(_EDGE), F.lit(k)) for k in (1, 2, 3)]
    one = rows.select(F.explode(F.arrays_zip(*(a.alias(n) for a, n in zip(arrow, ("src", "edge", "dst"), strict=True)))).alias("e")).select("e.*", F.lit(0.9).alias("conf"))
    at = [F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z]\w+(?: [A-Z]\w+)?) works at ([A-Z]\w+)"), F.lit(k)) for k in (1, 2)]
    two = rows.select(F.explode(F.arrays_zip(at[0].alias("src"), at[1].alias("dst"))).alias("e")).select(slugify("e.src").alias("src"), F.lit("works_at").alias("edge"), slugify("e.dst").alias("dst"), F.lit(0.6).alias("conf"))
    did = F.regexp_extract_all(F.col(text), F.lit(r"(?i)\bdecided to ([a-z0-9 ]{3,60})"), F.lit(1))
    three = rows.select(F.col(id_).alias("src"), F.lit("decided").alias("edge"), F.explode(did).alias("d")).select("src", "edge", slugify("d").alias("dst"), F.lit(0.5).alias("conf"))
    found = one.unionByName(two).unionByName(three)
    return found.groupBy("src", "edge", "dst").agg(F.max("conf").alias("conf")).withColumn("state", F.lit("queued"))


def queue(proposals: DataFrame, queued: DataFrame) -> DataFrame:
    """Proposals that aren't queued yet."""
    return proposals.join(queued.select("src", "edge", "dst"), ["src", "edge", "dst"], "left_anti")


def stubs(slugs: DataFrame, pages: DataFrame) -> DataFrame:
    """(slug, path) of tofile pages for slugs (dst) without a page."""
    return slugs.select(F.col("dst").alias("slug")).distinct().join(pages.select("slug"), "slug", "left_anti").select("slug", F.concat(F.lit("wiki/tofile/"), "slug", F.lit(".md")).alias("path"))


def fan_out(items: DataFrame, mentions: DataFrame, pages: DataFrame, batch_id: str, by_source: bool = True) -> DataFrame:
    """Changes (batch_id, source_path, path, op, before, after) of pages that items mention.

    items: path, channel, file_name, captured_at. mentions: path, slug, bullet, and verified if a mention says something of the page, which
    is then verified on that day if it wasn't later. A page that exists gets the bullet under "Mentions" and the item's final path as a source; others become tofile stubs. By source, each
    row is what one source would do to the page by itself, which is what gets reviewed: a page that two sources tell of is
    in both their diffs. Otherwise a row is a page with all that is told of it, and source_path is null: what is committed.
    """
    final = dated_path("channel", "captured_at", "file_name")
    told = mentions.join(items.select("path", final.alias("final")), "path")
    told = told.withColumn("source_path", F.col("final") if by_source else F.lit(None).cast("string"))
    told = told if "verified" in told.columns else told.withColumn("verified", F.lit(None).cast("date"))
    told = told.groupBy("slug", "source_path").agg(F.max("verified").alias("verified"), F.array_sort(F.collect_set(F.struct("final", "bullet"))).alias("told"))
    there = pages.withColumn("_is", F.lit(True)).drop("file_name")
    rows = told.join(there, "slug", "left")
    path = F.coalesce("path", F.concat(F.lit("wiki/tofile/"), "slug", F.lit(".md")))
    body = append_bullets(F.coalesce("body", F.lit("")), F.lit("Mentions"), F.transform("told", lambda t: t["bullet"]))
    sources = F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.transform("told", lambda t: t["final"]))
    kept = [c for c in pages.columns if c not in ("slug", "type", "path", "sources", "body", "file_name")]
    new = {"type": F.coalesce("type", F.lit("tofile")), "path": path, "sources": sources, "body": body} | {c: F.col(c) for c in kept}
    new |= {"last_verified": F.greatest("last_verified", "verified")} if "last_verified" in kept else {}
    old = F.when(F.col("_is"), F.struct(*(F.col(c) for c in new)))  # the page's own columns
    both = rows.select("source_path", "_is", path.alias("path"), F.struct(*(v.alias(k) for k, v in new.items())).alias("new"), old.alias("old"))
    rendered = both.mapInArrow(frontmatter.render_both, "source_path string, _is boolean, path string, before string, after string")
    op = F.when(F.col("_is"), "update").otherwise("create")
    return rendered.where(~F.col("before").eqNullSafe(F.col("after"))).select(F.lit(batch_id).alias("batch_id"), "source_path", "path", op.alias("op"), "before", "after")


def changes_between(before: DataFrame, after: DataFrame, batch_id: str) -> DataFrame:
    """(batch_id, path, op, before, after): how files (path, content) differ; equal ones are left out."""
    a, b = before.select("path", F.col("content").alias("before")), after.select("path", F.col("content").alias("after"))
    op = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("update")
    rows = a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return rows.select(F.lit(batch_id).alias("batch_id"), "path", op.alias("op"), "before", "after")


def diffs(changes: DataFrame) -> DataFrame:
    """(source_path, path, op, diff): a unified diff of each change."""
    source = F.col("source_path") if "source_path" in changes.columns else F.lit(None).cast("string")
    rows = changes.select(source.alias("source_path"), "path", "op", "before", "after")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", diff string"
    return rows.mapInArrow(frontmatter.diffs, fields).select("source_path", "path", "op", "diff")


def consolidated(changes: DataFrame) -> DataFrame:
    """(source_path, path, op, diff, n): one diff per source, as its changes in the order of paths, each with their number.

    A row per change: a source that touches a great many pages is as many rows, not one long text; the order is
    that of a range partitioning, so reading it from top to bottom is reading one diff after the other.
    """
    each = stash(diffs(changes), "diffs")  # read by the join and by the sort's ranges, worked out once
    sizes = each.groupBy("source_path").agg(F.count("*").alias("n"))
    same = F.col("source_path").eqNullSafe(F.col("_s"))
    return each.join(sizes.withColumnRenamed("source_path", "_s"), same).drop("_s").orderBy("source_path", "path")


def apply(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, content) after the changes: created and updated files have `after`, deleted ones go."""
    rows = files.select("path", "content").join(changes.select("path", "op", "after"), "path", "full_outer")
    return rows.where("op is null or op <> 'delete'").select("path", F.when(F.col("op").isNull(), F.col("content")).otherwise(F.col("after")).alias("content"))


def undo(files: DataFrame, changes: DataFrame, batch_id: str) -> DataFrame:
    """(path, content) before a batch: its creations go, its updates and deletions get `before` back."""
    own = changes.where(F.col("batch_id") == batch_id).select("path", F.col("op").alias("_op"), F.col("before").alias("_before"))
    rows = files.select("path", "content").join(own, "path", "full_outer")
    return rows.where("_op is null or _op <> 'create'").select("path", F.when(F.col("_op").isNull(), F.col("content")).otherwise(F.col("_before")).alias("content"))


def undo_plan(files: DataFrame, changes: DataFrame, batch_id: str) -> DataFrame:
    """(path, op, now, after, conflict): what undoing a batch makes of its pages (path, content), with what later batches did kept.

    A page that nobody touched since is as before. Of one that others changed, what the batch did is taken back by a three-way merge; where that
    isn't possible, as others changed the same lines or the batch made the page that they built on, conflict says so.
    """
    mine = F.col("batch_id") == batch_id
    own = changes.where(mine).select("path", "op", "before", "after")
    others = changes.where(~mine).join(own.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("batch_id")).alias("others"))
    rows = own.join(files.select("path", F.col("content").alias("now")), "path", "left").join(others, "path", "left")
    return rows.select("path", "op", "before", "after", "now", "others").mapInArrow(frontmatter.undone, "path string, op string, now string, after string, conflict string")


def dependents(changes: DataFrame, batch_id: str) -> DataFrame:
    """(batch_id) of the batches that have to be undone before one: those that changed a page which it made, those that changed what they made, and so on."""
    made = changes.where("op = 'create'").select(F.col("batch_id").alias("src"), "path")
    edges = made.join(changes.where("op <> 'create'").select(F.col("batch_id").alias("dst"), "path"), "path").where("src <> dst").select("src", "dst").distinct()
    seen = front = [batch_id]
    while front:  # a round a step; batches are few beside their changes
        front = [r["dst"] for r in edges.where(F.col("src").isin(front) & ~F.col("dst").isin(seen)).select("dst").distinct().collect()]
        seen = seen + front
    return changes.sparkSession.createDataFrame([(b,) for b in sorted(set(seen[1:]))], "batch_id string")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with the rows whose key it lacks; applying it twice is applying it once."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))
