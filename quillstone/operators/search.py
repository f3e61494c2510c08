"""A keyword index in segments, with top-k that stops early.

A segment holds the documents of one update, by terms and by documents. What an update changes or removes is not rewritten in
its old segment: its old version is listed as dead, and its new one is in the new segment. When a size class has FAN segments they are
merged into one, without their dead; so a posting is rewritten once for each class it passes, a logarithm of the index, and
an update costs what it brings.

Within a part of a segment's files documents are ordered by length and cut into windows of WINDOW documents. The postings of a term in a window
are one row, a block, which has its highest term count and its shortest document beside the postings. The sum of what these
allow over a question's terms bounds the score of any document of the window (block-max WAND, with windows in the place of the
pivots). The windows of the highest bounds are scored first; their k-th score is a threshold, and windows that can't reach it are
never read. The answer is that of scoring every posting.

Scale. Blocks lie in files by term and part, so a term that every document has is many rows in many files, and
a question reads the bounds of its own terms alone, then some blocks. The driver holds a row per segment (FAN a class at most) and
per term of a question, and k scores. Dead versions are joined by id; they are fewer than the live of their segments, as a segment that is
mostly dead is merged away.

Ids are unique, as slugs are. A null text has no terms, but counts as a document; null ids are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import tokens
from quillstone.operators.graph import small
from quillstone.operators.retrieval import B, DIMENSIONS, K1, counted, top, vectors_of_rows
from quillstone.shared import stash
from quillstone.store import Store

WINDOW = 16  # documents; fewer make closer bounds and more rows of them
FAN = 8  # segments of a size class that are merged
LEAST = 10_000  # postings of the smallest class
FIRST = 4  # windows that are scored first, times as many as k documents fill
_FORWARD = "id string, hash long, dl long, terms array<string>, tfs array<int>"
_VECTORS = "id string, vector array<double>"
_DEAD = "seg long, id string, dl long, terms array<string>"
_BLOCKS = "term string, win long, n int, max_tf int, min_dl long, ids array<string>, tfs array<int>, dls array<long>"


def forward(docs: DataFrame) -> DataFrame:
    """(id, hash, dl, terms, tfs) of documents (id, text): each one's terms with their counts, from its own row."""
    rows = docs.where("id is not null").select(F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("hash"), tokens("text").alias("w"))
    return counted(rows, "id", "hash")


def _windows(window: int):
    """A worker's function: the blocks of documents that come in order."""

    def run(parts):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        win = TaskContext.get().partitionId() << 32
        for whole in parts:
            for begin in range(0, whole.num_rows, 64 * window):
                docs = whole.slice(begin, 64 * window)
                coded = docs.column("terms").flatten().dictionary_encode()
                if len(coded):
                    doc = np.repeat(np.arange(docs.num_rows), docs.column("terms").value_lengths().to_numpy())
                    key = doc // window * len(coded.dictionary) + coded.indices.to_numpy()
                    order = np.argsort(key, kind="stable")
                    key, doc = key[order], doc[order]
                    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    ends = pa.array(np.append(starts, len(key)).astype(np.int32))
                    tfs, dls = docs.column("tfs").flatten().to_numpy()[order], docs.column("dl").to_numpy()[doc]
                    lists = (pa.ListArray.from_arrays(ends, v) for v in (docs.column("id").take(pa.array(doc)), pa.array(tfs), pa.array(dls)))
                    columns = [coded.dictionary.take(pa.array(key[starts] % len(coded.dictionary))), pa.array(win + key[starts] // len(coded.dictionary)), pa.array(np.diff(ends).astype(np.int32)), pa.array(np.maximum.reduceat(tfs, starts)), pa.array(np.minimum.reduceat(dls, starts))]
                    yield pa.RecordBatch.from_arrays([*columns, *lists], ["term", "win", "n", "max_tf", "min_dl", "ids", "tfs", "dls"])
                win += -(-docs.num_rows // window)

    return run


def blocks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The blocks of documents as `forward` gives them, sorted by (term, window) within files.

    Each part of the files of `rows` is sorted by length and cut into windows, the last of a batch shorter. A window's postings are put together where
    its documents are, so blocks are shuffled and neither documents nor postings; a term goes to as many places as there are parts.
    """
    ordered = rows.select("id", "dl", "terms", "tfs").sortWithinPartitions("dl", "id")
    return ordered.mapInArrow(_windows(window), _BLOCKS).repartition("term", F.shiftright("win", 32)).sortWithinPartitions("term", "win")


def part(idf: Column, tf: Column, dl: Column, average: float, k1: float, b: float) -> Column:
    """What a term adds to a document's score; more for a higher tf and for a smaller dl."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(average)))


@dataclass(frozen=True)
class Found:
    """The best documents (id, score), and how many postings the question's terms have and how many of them were read."""

    rows: DataFrame
    postings: int
    read: int


@dataclass(frozen=True)
class Segment:
    number: int
    docs: int
    length: int
    postings: int
    dead: int
    dead_length: int
    blocks: str
    forward: str
    vectors: str


class SearchIndex:
    """An index in a folder that all executors share. Each update is one commit; readers keep the version that they began with."""

    def __init__(self, spark: SparkSession, base: str, window: int = WINDOW, fan: int = FAN, least: int = LEAST, dimensions: int = DIMENSIONS):
        self.spark, self.window, self.fan, self.least, self.dimensions = spark, window, fan, least, dimensions
        self._store = Store(spark, base)

    def segments(self) -> list[Segment]:
        return [Segment(**s) for s in self._store.latest()[1].get("segments", {}).get("rows", [])]

    def _read(self, name: str, own: list[Segment], ddl: str) -> DataFrame:
        """The rows of segments with their segment's number."""
        out = None
        for s in own:
            rows = self._store.read([getattr(s, name)], ddl).withColumn("seg", F.lit(s.number).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"{ddl}, seg long")

    def dead(self) -> DataFrame:
        """(seg, id, dl, terms): versions that an update replaced or removed."""
        return self._store.read(self._store.latest()[1].get("dead", {}).get("parts", []), _DEAD)

    def live(self) -> DataFrame:
        """`forward` rows of all documents with their segment."""
        return self._read("forward", self.segments(), _FORWARD).join(self.dead().select("seg", "id"), ["seg", "id"], "left_anti")

    def vectors(self) -> DataFrame:
        """(id, vector) of all documents with terms, hashed."""
        return self._read("vectors", self.segments(), _VECTORS).join(self.dead().select("seg", "id"), ["seg", "id"], "left_anti").select("id", "vector")

    def _written(self, rows: DataFrame, number: int) -> Segment | None:
        """A new segment of `forward` rows; none if there are no rows."""
        at = self._store.write(rows.select("id", "hash", "dl", "terms", "tfs"), "forward")
        own = self._store.read([at], _FORWARD)
        docs, length, postings = own.agg(F.count("*"), F.sum("dl"), F.sum(F.size("terms").cast("long"))).first()
        if not docs:
            return None
        vectors = self._store.write(vectors_of_rows(own, self.dimensions), "vectors")
        return Segment(number, docs, length, postings, 0, 0, self._store.write(blocks(own, self.window), "blocks"), at, vectors)

    def _class(self, s: Segment) -> int:
        return int(math.log(max(s.postings, self.least) / self.least, self.fan))

    def _due(self, segments: list[Segment]) -> list[Segment]:
        """Segments to merge: a size class that is full, or what is mostly dead."""
        for level in sorted({self._class(s) for s in segments}):
            own = [s for s in segments if self._class(s) == level]
            if len(own) >= self.fan:
                return own
        return [s for s in segments if 2 * s.dead > s.docs]

    def update(self, docs: DataFrame) -> tuple[int, int, int]:
        """Bring the index to `docs` (id, text), all documents there are; (documents added or changed, removed or replaced, postings written).

        Texts are told apart by a 64-bit hash of each. Without changes nothing is written.
        """
        began, tables = self._store.latest()
        segments, written = self.segments(), 0
        now = docs.where("id is not null").select(F.col("id").cast("string").alias("id"), "text")
        if not segments:  # all of it comes: no text has to meet what is there
            own = self._written(forward(now), 1)
            if own:
                self._store.commit(began, {"segments": {"parts": [own.blocks, own.forward, own.vectors], "rows": [own.__dict__]}, "dead": {"parts": []}})
            return (own.docs, 0, own.postings) if own else (0, 0, 0)
        hashed = now.select("id", F.xxhash64("text").alias("hash"))
        had = self.live().select("id", "hash", "seg")
        apart = hashed.alias("a").join(had.alias("b"), "id", "full_outer").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        apart = stash(apart.select("id", F.col("a.hash").isNotNull().alias("comes"), F.col("seg")), "search-changes")
        comes, goes = apart.agg(F.count_if("comes"), F.count("seg")).first()
        if not comes and not goes:
            return 0, 0, 0
        gone = self._read("forward", segments, _FORWARD).join(small(apart.where("seg is not null").select("seg", "id")), ["seg", "id"], "left_semi")
        parts = list(tables.get("dead", {}).get("parts", []))
        if goes:
            parts.append(self._store.write(gone.select("seg", "id", "dl", "terms"), "dead"))
            new = self._store.read(parts[-1:], _DEAD)
            by = {r["seg"]: r for r in new.groupBy("seg").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()}  # a row a segment
            segments = [replace(s, dead=s.dead + by[s.number]["n"], dead_length=s.dead_length + by[s.number]["dl"]) if s.number in by else s for s in segments]
        number = 1 + max((s.number for s in segments), default=0)
        if comes:
            own = self._written(forward(now.join(small(apart.where("comes").select("id")), "id", "left_semi")), number)
            segments, written = [*segments, own], own.postings
        while due := self._due(segments):
            number += 1
            all_dead = self._store.read(parts, _DEAD)
            kept = self._read("forward", due, _FORWARD).join(all_dead.select("seg", "id"), ["seg", "id"], "left_anti")
            one = self._written(kept, number)
            numbers = [s.number for s in due]
            parts = [self._store.write(all_dead.where(~F.col("seg").isin(numbers)), "dead")] if parts else []
            segments = [s for s in segments if s.number not in numbers] + ([one] if one else [])
            written += one.postings if one else 0
        entry = {"parts": [p for s in segments for p in (s.blocks, s.forward, s.vectors)], "rows": [s.__dict__ for s in segments]}
        self._store.commit(began, {"segments": entry, "dead": {"parts": parts}})
        return comes, goes, written

    def vacuum(self, keep: int = 2) -> int:
        return self._store.vacuum(keep)

    def top(self, terms: list[str], k: int, digits: int = 6, k1: float = K1, b: float = B) -> Found:
        """The k best by BM25, scores rounded to `digits`, ties by id."""
        terms, segments, dead = sorted(set(terms)), self.segments(), self.dead()
        n, length = sum(s.docs - s.dead for s in segments), sum(s.length - s.dead_length for s in segments)
        own = self._read("blocks", segments, _BLOCKS).where(F.col("term").isin(terms))
        counts = {r["term"]: r["n"] for r in own.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one a term of the question
        lost = {r["term"]: r["n"] for r in dead.select(F.explode("terms").alias("term")).where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}
        df = {t: m - lost.get(t, 0) for t, m in counts.items() if m > lost.get(t, 0)}
        if not df:
            return Found(self.spark.createDataFrame([], "id string, score double"), sum(counts.values()), 0)
        average = length / n
        idf = F.element_at(F.create_map(*(F.lit(x) for t, d in sorted(df.items()) for x in (t, math.log(1 + (n - d + 0.5) / (d + 0.5))))), F.col("term"))
        own = own.where(F.col("term").isin(sorted(df)))
        bound = part(idf, F.col("max_tf"), F.col("min_dl"), average, k1, b)
        windows = stash(own.groupBy("seg", "win").agg(F.sum(bound).alias("bound"), F.sum("n").alias("n")), "search-bounds")

        def scored(some: DataFrame) -> DataFrame:
            """(id, score) of the live documents of some windows."""
            read = own.join(small(some.select("seg", "win")), ["seg", "win"], "left_semi")
            each = read.select("seg", idf.alias("idf"), F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
            sums = each.groupBy("seg", F.col("p.ids").alias("id")).agg(F.sum(part(F.col("idf"), F.col("p.tfs"), F.col("p.dls"), average, k1, b)).alias("score"))
            return sums.join(dead.select("seg", "id"), ["seg", "id"], "left_anti").select("id", F.round("score", digits).alias("score"))

        best = windows.orderBy(F.desc("bound"), "seg", "win").limit(FIRST * (1 + k // self.window))
        first = stash(best, "search-first")
        found = stash(scored(first), "search-scores")
        reached = [r["score"] for r in top(found, k).collect()]
        least = reached[-1] - 2 * 10.0**-digits if len(reached) == k else -math.inf  # so much for rounding
        rest = windows.join(F.broadcast(first.select("seg", "win")), ["seg", "win"], "left_anti").where(F.col("bound") >= F.lit(least))
        read = first.agg(F.sum("n")).first()[0] + (rest.agg(F.sum("n")).first()[0] or 0)
        return Found(top(found.unionByName(scored(rest)), k), sum(counts.values()), read)
