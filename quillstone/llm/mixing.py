"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the mix by weight, at most `most` times its own size; what a source can't take is shared
again by weight among the others. Every document of a source is wanted target / size times: so many whole
copies, and a fractional one with the probability that is left. Fractions are rounded in pairs: mass passes at random
from one document to the other, as many words as it takes from there, until one of the two is whole. That keeps
every document's expected copies and, exactly, the words of the pair. So a source ends within one
document of its target, where independent draws would stray with the root of its size. The last
fraction of a source has nobody left to pair with and goes to the nearer whole.

Scale. Fractions are rounded in groups of about GROUP documents, dealt by a hash within a source, so a source that holds most
rows is many groups; each leaves one fraction at most, and these meet in groups again, a tree whose height is a
logarithm. Workers hold GROUP rows and a batch at a time, of ids and sizes, never texts. Targets come from one row of sums a
round. Random numbers are hashes of the seed and the documents' ids and sizes, so runs agree however rows are partitioned.

Defined cases: a document without words, null text included, is taken with 0 words and no copies; a null source is a source, the last one; rows of
one id, source and size, a null id among them, are counted as one kind, which has so many copies altogether, and which of them has the
copy more is arbitrary; an empty table gives no rows; columns of other names are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import mix as scramble
from quillstone.llm.common import batches, stash
from quillstone.operators.graph import small
from quillstone.shared import numbered

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
GROUP = 8192
_NAMES = ("_source", "_id", "_size", "_part")


def words_of(text: str | Column = "text") -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, number, target) from (source, source_size): by weight, at most `most` times a size, the excess shared again until none is above."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    rows = stash(numbered(sources, F.asc_nulls_last("source")).withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(most))}), "sources")
    wanted = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    per, full = -1.0, F.lit(False)
    exact = lambda c, when: F.sum(F.when(when, F.col(c).cast("decimal(38,9)")))  # noqa: E731 - so that sums don't depend on their order
    while True:  # each round but the last adds sources to the full ones
        open_, filled = rows.agg(exact("w", ~full), exact("cap", full)).first()
        if not open_:
            break
        new = max((wanted - float(filled or 0)) / float(open_), 0.0)
        if new <= per:
            break
        per = new
        full = F.col("cap") <= F.col("w") * F.lit(per)
    return rows.select("source", "source_size", "number", F.when(full, F.col("cap")).otherwise(F.col("w") * F.lit(max(per, 0.0))).alias("target"))


def settle(group: np.ndarray, size: np.ndarray, x: np.ndarray, key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The fractions `x` of documents after rounding in pairs within each group: 0 or 1 but for one a group at most.

    The largest document is paired with the next smaller; whichever of a pair stays a fraction meets the one after. So a
    large document meets all smaller ones until it is whole, and what is open at a group's end is seldom large.
    level: a number that differs from one level of the tree to the next, as the random numbers shall.
    """
    order = np.lexsort((key, -size, group))
    u = ((scramble(key + scramble(level.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)).astype(float) / 2.0**53)[order].tolist()
    groups, sizes, out = group[order].tolist(), size[order].astype(float).tolist(), x[order].astype(float).tolist()
    i = -1  # the open document
    for j in range(len(out)):
        if not 0 < out[j] < 1:
            continue
        if i < 0 or groups[i] != groups[j]:
            i = j
            continue
        a, b, p, q = sizes[i], sizes[j], out[i], out[j]
        i_full, j_empty, i_empty, j_full = (1 - p) * a, q * b, p * a, (1 - q) * b  # words that would have to pass for that
        up, down = min(i_full, j_empty), min(i_empty, j_full)
        # The bound that is met is set as a whole number, so that rounding errors leave no crumbs.
        if u[j] * (up + down) < down:
            out[i] = 1.0 if i_full <= j_empty else p + up / a
            out[j] = 0.0 if j_empty <= i_full else q - up / b
        else:
            out[i] = 0.0 if i_empty <= j_full else p - down / a
            out[j] = 1.0 if j_full <= i_empty else q + down / b
        i = i if 0 < out[i] < 1 else j if 0 < out[j] < 1 else -1
    done = np.empty(len(out))
    done[order] = out
    return done


def _settled(parts):
    """Batches sorted by group, settled in runs of whole groups."""
    held, rows = [], 0

    def done(table):
        group = np.stack([np.asarray(table.column(c)) for c in ("number", "chunk")], 1)
        fresh = np.r_[True, (group[1:] != group[:-1]).any(1)] if len(group) else np.zeros(0, bool)
        x = settle(np.cumsum(fresh), np.asarray(table.column("_size")), np.asarray(table.column("x")), np.asarray(table.column("key")).astype(np.int64).view(np.uint64), np.asarray(table.column("chunks")))
        return table.set_column(table.schema.get_field_index("x"), "x", pa.array(x)).to_batches()

    for batch in parts:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= 4 * GROUP:
            table = pa.Table.from_batches(held)
            same = (np.asarray(table.column("number")) == table.column("number")[-1].as_py()) & (np.asarray(table.column("chunk")) == table.column("chunk")[-1].as_py())
            cut = rows - int(same[::-1].argmin() if not same.all() else rows)
            if cut:
                yield from done(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), rows - cut
    if held:
        yield from done(pa.Table.from_batches(held))


def _whole(items: DataFrame) -> DataFrame:
    """Items (number, _id, _size, key, x, chunk, chunks) with x rounded to 0 or 1, level by level of the tree."""
    out, schema = [], items.schema
    while True:
        dealt = items.repartition("number", "chunk").sortWithinPartitions("number", "chunk")
        level = stash(dealt.mapInArrow(_settled, schema), "mixing")
        last = level.agg(F.max("chunks")).first()[0] or 1
        open_ = (F.col("x") > 0) & (F.col("x") < 1)
        if last == 1:
            out.append(level.withColumn("x", F.when(F.col("x") >= 0.5, 1.0).otherwise(0.0)))
            break
        out.append(level.where(~open_))
        fewer = F.ceil(F.col("chunks") / GROUP).cast("long")
        items = level.where(open_).withColumns({"chunk": F.pmod("chunk", fewer), "chunks": fewer})
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def mix(docs: DataFrame, size: str, doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """The rows of `docs` with source_size, target (their source's), copies (of the row that the mix takes) and taken (words of these).

    size: the column of words a row. Columns of those four names are replaced. `repeated` gives the mix itself.
    """
    batches(docs.sparkSession)
    own = docs.drop("source_size", "target", "copies", "taken")
    rows = own.withColumns({"_source": F.col(source), "_id": F.col(doc_id), "_size": F.coalesce(F.col(size).cast("long"), F.lit(0)), "_part": F.spark_partition_id()})
    rows = stash(rows, "mixing-rows")
    kinds = rows.groupBy(*_NAMES).agg(F.count("*").alias("here"))
    by_source = targets(kinds.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("here")).alias("source_size")), weights, share, most)
    by_source = stash(by_source, "mixing-targets")
    kind = Window.partitionBy("_source", "_id", "_size")
    # A row a partition that has a kind: how many rows of it lie in partitions before, and in all.
    kinds = kinds.withColumns({"before": F.coalesce(F.sum("here").over(kind.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("here").over(kind)})
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    kinds = kinds.join(small(by_source), F.col("_source").eqNullSafe(F.col("source"))).drop("source").withColumn("each", wanted)
    kinds = stash(kinds.withColumns({"whole": F.floor("each"), "extra": F.col("n") * (F.col("each") - F.floor("each"))}), "mixing-kinds")
    key = F.xxhash64(F.lit(seed), F.col("_source"), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_size")
    open_ = (F.col("before") == 0) & (F.col("_size") > 0) & (F.col("extra") > F.floor("extra"))
    items = kinds.where(open_).select("number", "_id", "_size", key.alias("key"), (F.col("extra") - F.floor("extra")).alias("x"))
    chunks = items.groupBy("number").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    items = items.join(small(chunks), "number").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    one = _whole(items.select("number", "_id", "_size", "key", "x", "chunk", "chunks")).select("number", "_id", "_size", "x")
    same = lambda a, b: (a["number"] == b["number"]) & a["_id"].eqNullSafe(b["_id"]) & (a["_size"] == b["_size"])
    kinds = kinds.join(one, same(kinds, one), "left").select(*(kinds[c] for c in (*_NAMES, "here", "before", "source_size", "target", "whole")), (F.floor(kinds["extra"]) + F.coalesce("x", F.lit(0.0))).cast("long").alias("ones"))
    place = F.row_number().over(Window.partitionBy(*_NAMES).orderBy("_size"))
    rows = rows.withColumn("_place", place).alias("r")
    k = kinds.alias("k")
    on = (F.col("r._part") == F.col("k._part")) & (F.col("r._size") == F.col("k._size")) & F.col("r._id").eqNullSafe(F.col("k._id")) & F.col("r._source").eqNullSafe(F.col("k._source"))
    more = (F.col("k.before") + F.col("r._place") <= F.col("k.ones")).cast("long")
    copies = F.when(F.col("r._size") > 0, F.col("k.whole") + more).otherwise(F.lit(0)).cast("long")
    out = rows.join(k, on).select(*(F.col(f"r.`{c}`") for c in own.columns), "k.source_size", "k.target", copies.alias("copies"), F.col("r._size").alias("_size"))
    return out.withColumn("taken", F.col("copies") * F.col("_size")).drop("_size")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix: each row of `mix` as often as it is taken."""
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1))))).where("copies > 0")


common.ship(__name__)
