"""An approximate vector index: coarse lists, product-quantised residuals, several lists probed, candidates ranked again exactly.

Vectors are scaled to length 1, so that a dot product is a cosine. Coarse centroids are fitted to all vectors by k-means whose
rounds are aggregates: a task sums the vectors that went to each centroid, Spark adds the sums up, and the driver holds a
row per centroid. A vector is kept in the list of its nearest centroid as a code, one byte for each PART components of what
is left after the centroid, by codebooks fitted in the same way. A search visits the `probes` nearest lists, scores
their codes by table look-up, and ranks the `refine` * k best again by their true vectors; `refine` is measured for NEAR answers, as codes tell fewer vectors apart the more there are, and
fewer answers get as many candidates. `exact=True` scans everything instead.

Scale. Codes and vectors lie in files by ranges of list, so a search reads `probes` of the lists, a byte for every PART
components, and `refine` * k vectors. Lists are dealt into blocks of BLOCK vectors at most on average, by a hash of the id, so that a list that holds a third of
all vectors is many groups; a query that probes it goes to each of them. Centroids are at most LISTS, codebooks at most 256 entries a part.

Null vectors, vectors with null or non-finite components or of length 0, and vectors of another size than most are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.graph import small
from quillstone.operators.retrieval import cosine, top
from quillstone.shared import stash
from quillstone.store import Store

LISTS, PART, ENTRIES, ROUNDS = 4096, 4, 256, 4
REFINE, BLOCK = 1, 4096  # REFINE: times k that are ranked again, at least
MOST_REFINE, REFINE_SAMPLE = 160, 32  # times k at most, and vectors by which it is measured
RECALL, SAMPLE, NEAR = 0.97, 128, 20
_STEP = 1024  # vectors that are compared with all centroids at a time
_CODES = "list int, block int, id string, code binary"
_VECTORS = "list int, block int, id string, vector array<float>"
_MODEL = "kind string, i int, values array<double>"


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of each point's nearest centre, the lowest of those at one distance."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - points[i : i + _STEP] @ centres.T).argmin(1) for i in range(0, len(points), _STEP)] or [np.zeros(0, np.int64)])


def _parts(size: int) -> list[int]:
    return [*range(0, size, PART), size]


def _sums(of, books: list[np.ndarray], at: list[int]):
    """A worker's function: (part, entry, n, sums) of what `of` makes of the vectors."""

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape) for b in books]
        for batch in batches:
            if batch.num_rows:
                points = of(_matrix(batch.column("v")))
                for p, book in enumerate(books):
                    own = points[:, at[p] : at[p + 1]]
                    to = nearest(own, book)
                    counts[p] += np.bincount(to, minlength=len(book))
                    np.add.at(sums[p], to, own)
        met = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
        columns = [pa.array([p for p, _ in met], pa.int32()), pa.array([int(e) for _, e in met], pa.int32()), pa.array([int(counts[p][e]) for p, e in met], pa.int64()), pa.array([sums[p][e].tolist() for p, e in met], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def fit(rows: DataFrame, books: list[np.ndarray], at: list[int], of=lambda x: x, rounds: int = ROUNDS) -> list[np.ndarray]:
    """k-means over all `rows` (v), each part of `of` of the vectors with a codebook of its own; entries that nothing goes to stay."""
    for _ in range(rounds):
        met = rows.select("v").mapInArrow(_sums(of, books, at), "part int, entry int, n long, sums array<double>")
        flat = met.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        found = flat.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("s") / F.col("n")).alias("mean")))).alias("m")).collect()  # an entry a row
        books = [b.copy() for b in books]
        for r in found:
            books[r["part"]][r["entry"]] = [x["mean"] for x in r["m"]]
    return books


def _placed(centres: np.ndarray, books: list[np.ndarray], at: list[int]):
    """A worker's function: the list and code of each vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("v"))
                to = nearest(points, centres)
                left = points - centres[to]
                code = np.stack([nearest(left[:, i:j], b) for b, i, j in zip(books, at, at[1:], strict=False)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v").cast(pa.list_(pa.float32())), pa.array(to, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "vector", "list", "code"])

    return run


def _scored(keep: int, books: list[np.ndarray], at: list[int]):
    """A function of a block's queries and codes: each query's best ids by their codes, or by their vectors where the block has these."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        qid, ids, score = [], [], []
        if asked.num_rows and held.num_rows:
            held = held.sort_by("id")  # so that ties go by id
            whole = _matrix(held.column("vector")) if "vector" in held.column_names else None
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1) if whole is None else None
            queries, own = _matrix(asked.column("v")), held.column("id").to_pylist()
            for name, q, base in zip(asked.column("qid").to_pylist(), queries, asked.column("base").to_pylist(), strict=True):
                s = whole @ q if whole is not None else sum((b @ q[i:j])[codes[:, p]] for p, (b, i, j) in enumerate(zip(books, at, at[1:], strict=False))) + base
                best = np.argsort(-s, kind="stable")[:keep]
                qid += [name] * len(best)
                ids += [own[i] for i in best]
                score += s[best].tolist()
        where = held.column("list")[0].as_py() if held.num_rows else 0
        return pa.table({"qid": pa.array(qid, pa.string()), "list": pa.array([where] * len(qid), pa.int32()), "id": pa.array(ids, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def _near(asked: np.ndarray, keep: int):
    """A worker's function: (q, list, id, score) of its vectors that are nearest to each of a few queries."""

    def run(batches):
        best = [[] for _ in asked]
        for batch in batches:
            if batch.num_rows:
                dots, lists, ids = asked @ _matrix(batch.column("vector")).T, batch.column("list").to_pylist(), batch.column("id").to_pylist()
                for q, s in enumerate(dots):
                    best[q] += [(-s[i], ids[i], lists[i]) for i in np.argsort(-s, kind="stable")[:keep].tolist()]
                    best[q] = sorted(best[q])[:keep]
        rows = [(q, where, name, -s) for q, found in enumerate(best) for s, name, where in found]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)], ["q", "list", "id", "score"])

    return run


def _order(centres: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The lists by their distance from each point."""
    return np.argsort((centres**2).sum(1) / 2 - points @ centres.T, axis=1, kind="stable")


def probes_for(placed: DataFrame, centres: np.ndarray, asked: np.ndarray, recall: float = RECALL) -> tuple[int, list]:
    """How many lists hold `recall` of the nearest vectors of `asked`, by one scan, and these nearest as (q, list, id)."""
    near = placed.select("list", "id", "vector").mapInArrow(_near(asked, NEAR), "q int, list int, id string, score double")
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_rank") <= NEAR)
    found = ranked.select("q", "list", "id").collect()  # SAMPLE * NEAR at most
    place = np.argsort(_order(centres, asked), axis=1)
    ranks = np.sort([place[r["q"], r["list"]] for r in found])
    return int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1, found


def _probes(centres: np.ndarray, probes: int):
    """A worker's function: (qid, v, list, base) of the lists that each query goes to."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("v"))
                dots = points @ centres.T
                to = _order(centres, points)[:, :probes]
                row = np.repeat(np.arange(len(points)), to.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("qid", "v")] + [pa.array(to.ravel(), pa.int32()), pa.array(dots[row, to.ravel()])], ["qid", "v", "list", "base"])

    return run


class VectorIndex:
    """An index in a folder that all executors share; `build` commits a new version."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self._store, self._models = spark, Store(spark, base), {}

    def _table(self, name: str, ddl: str) -> DataFrame:
        return self._store.read(self._store.latest()[1].get(name, {}).get("parts", []), ddl)

    @staticmethod
    def _unit(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
        """(id, v) scaled to length 1, without what has no direction."""
        v = F.transform(vector, lambda x: x.cast("double"))
        rows = vectors.select(F.col(id_).cast("string").alias("id"), v.alias("v")).where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return rows.withColumn("n", norm).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))

    def build(self, vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> int:
        """Index `vectors`; how many are in it. lists: by default the root of their number, LISTS at most."""
        began, _ = self._store.latest()
        rows = stash(self._unit(vectors, id_, vector), "vectors")
        most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        if most is None:
            self._store.commit(began, {})
            return 0
        rows, n = rows.where(F.size("v") == most["size"]), most["count"]
        lists = lists or min(LISTS, max(1, round(math.sqrt(n))))
        start = rows.orderBy(F.xxhash64("id"), "id").limit(max(lists, ENTRIES) + SAMPLE).select("v").collect()  # the first centroids and codes, and vectors to measure by
        seed = np.array([r["v"] for r in start])
        # Vectors that centroids or codes began as are closer to these than others, and would promise too much.
        seed, others = seed[: max(lists, ENTRIES)], seed[max(lists, ENTRIES) :]
        asked = others if len(others) else seed[:SAMPLE]
        (centres,) = fit(rows, [seed[:lists]], [0, most["size"]])
        at, left = _parts(most["size"]), lambda x: x - centres[nearest(x, centres)]
        first = left(seed[:ENTRIES])
        books = fit(rows, [first[:, i:j] for i, j in zip(at, at[1:], strict=False)], at, left)
        placed = stash(rows.mapInArrow(_placed(centres, books, at), "id string, vector array<float>, list int, code binary"), "vectors-placed")
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row a list
        coded = placed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        probes, true = probes_for(placed, centres, asked)
        model = [("probes", probes, []), ("refine", self._refine_for(coded, sizes, centres, books, probes, asked[:REFINE_SAMPLE], true), [])] + [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [(f"part{p}", i, e.tolist()) for p, b in enumerate(books) for i, e in enumerate(b)]
        parts = {
            "codes": coded.select("list", "block", "id", "code").repartitionByRange("list", "id").sortWithinPartitions("list", "id"),
            "vectors": coded.select("list", "block", "id", "vector").repartitionByRange("list", "id").sortWithinPartitions("list", "id"),
            "lists": coded.groupBy("list", "block").agg(F.count("*").alias("n")),
            "model": self.spark.createDataFrame(model, _MODEL),
        }
        self._store.commit(began, {name: {"parts": [self._store.write(df, name)]} for name, df in parts.items()})
        return n

    def _model(self) -> tuple[np.ndarray, list[np.ndarray]]:
        number = self._store.latest()[0]
        if number not in self._models:
            held: dict[str, list] = {}
            for r in self._table("model", _MODEL).orderBy("kind", "i").collect():  # LISTS and ENTRIES bound it
                held.setdefault(r["kind"], []).append(r["values"])
            held.pop("probes", None)
            held.pop("refine", None)
            self._models = {number: (np.array(held.pop("centre", [])), [np.array(held[f"part{p}"]) for p in range(len(held))])}
        return self._models[number]

    @property
    def probes(self) -> int:
        """How many lists a search probes unless told."""
        row = self._table("model", _MODEL).where("kind = 'probes'").first()
        return row["i"] if row else 0

    @property
    def refine(self) -> int:
        """How many times k candidates a search ranks again unless told."""
        row = self._table("model", _MODEL).where("kind = 'refine'").first()
        return row["i"] if row else REFINE

    def _refine_for(self, coded: DataFrame, sizes: DataFrame, centres: np.ndarray, books: list[np.ndarray], probes: int, asked: np.ndarray, true: list) -> int:
        """How many times NEAR candidates by code hold RECALL of the true nearest vectors of `asked` that the probed lists have."""
        spark = self.spark
        queries = spark.createDataFrame([(str(q), v.tolist()) for q, v in enumerate(asked)], "qid string, v array<double>")
        blocks = sizes.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
        goes = queries.mapInArrow(_probes(centres, probes), "qid string, v array<double>, list int, base double").join(small(blocks), "list")
        scored = goes.groupBy("list", "block").cogroup(coded.select("list", "block", "id", "code").groupBy("list", "block")).applyInArrow(_scored(MOST_REFINE * NEAR, books, _parts(centres.shape[1])), "qid string, list int, id string, score double")
        near = F.broadcast(spark.createDataFrame([(str(r["q"]), r["id"]) for r in true if r["q"] < len(asked)], "qid string, id string"))  # REFINE_SAMPLE * NEAR at most
        ranked = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
        ranks = sorted(r["_rank"] for r in ranked.join(near, ["qid", "id"]).select("_rank").collect())
        return min(MOST_REFINE, max(REFINE, math.ceil(ranks[math.ceil(RECALL * len(ranks)) - 1] / NEAR))) if ranks else REFINE

    def search(self, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", probes: int | None = None, refine: int | None = None, lists: list[int] | None = None, exact: bool = False) -> DataFrame:
        """(qid, id, score): the k best of every query, ties by id. lists: those that the queries are known to probe, to read no others; exact: by all vectors, block by block."""
        centres, books = self._model()
        if not len(centres):
            return self.spark.createDataFrame([], "qid string, id string, score double")
        probes, keep = (len(centres), k) if exact else (probes or self.probes, self._candidates(k, refine))
        asked = self._unit(queries, id_, vector).where(F.size("v") == centres.shape[1]).withColumnRenamed("id", "qid")
        codes, vectors, blocks = self._table("codes", _CODES), self._table("vectors", _VECTORS), self._table("lists", "list int, block int, n long")
        if lists is not None:
            codes, vectors = (df.where(F.col("list").isin(lists)) for df in (codes, vectors))
        goes = asked.mapInArrow(_probes(centres, probes), "qid string, v array<double>, list int, base double").join(small(blocks.select("list", "block")), "list")
        near = goes.groupBy("list", "block").cogroup((vectors if exact else codes).groupBy("list", "block")).applyInArrow(_scored(keep, books, _parts(centres.shape[1])), "qid string, list int, id string, score double")
        best = lambda df, n: df.withColumn("_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("_rank") <= n).drop("_rank")
        if exact:
            return best(near, k).select("qid", "id", "score")
        wanted = best(near, keep).select("qid", "list", "id")
        dot = F.aggregate(F.zip_with("v", "vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        again = vectors.join(wanted, ["list", "id"]).join(asked, "qid").select("qid", "id", dot.alias("score"))
        return best(again, k)

    def vectors(self) -> DataFrame:
        """(list, block, id, vector) of all vectors, at length 1."""
        return self._table("vectors", _VECTORS)

    def top(self, query: list[float], k: int, probes: int | None = None, refine: int | None = None, exact: bool = False) -> DataFrame:
        """(id, score): the k best by cosine; exact: by scanning all vectors."""
        if exact:
            return top(cosine(self.vectors(), query, "id", "vector"), k)
        probes = probes or self.probes
        one = self.spark.createDataFrame([("q", [float(x) for x in query])], "vec_id string, embedding array<double>")
        return self.search(one, k, probes=probes, refine=refine, lists=self._lists(query, probes)).select("id", "score").orderBy(F.desc("score"), "id")

    def _lists(self, query: list[float], probes: int) -> list[int]:
        centres = self._model()[0]
        q = np.array(query, float)
        norm = np.linalg.norm(q)
        return _order(centres, q[None] / norm)[0, :probes].tolist() if len(centres) and norm else []

    def _candidates(self, k: int, refine: int | None) -> int:
        """How many vectors a search ranks again: `refine` * k, or those measured for NEAR answers, at least, unless told."""
        return refine * k if refine else self.refine * max(k, NEAR)

    def costs(self, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", probes: int | None = None, refine: int | None = None) -> DataFrame:
        """(qid, read, least, whole) of every query: bytes of codes, ids and vectors that its search needs, of its k answers, which any search reads, and of all vectors and ids; ids as 8 bytes."""
        centres, books = self._model()
        if not len(centres):
            return self.spark.createDataFrame([], "qid string, read long, least long, whole long")
        asked = self._unit(queries, id_, vector).where(F.size("v") == centres.shape[1]).withColumnRenamed("id", "qid")
        lists = self._table("lists", "list int, block int, n long").groupBy("list").agg(F.sum("n").alias("n"))  # a row a list
        n, one = lists.agg(F.sum("n")).first()[0], 4 * centres.shape[1] + 8
        goes = asked.mapInArrow(_probes(centres, probes or self.probes), "qid string, v array<double>, list int, base double").select("qid", "list")
        own = goes.join(small(lists), "list").groupBy("qid").agg(F.sum("n").alias("own"))
        read = F.col("own") * (len(books) + 8) + F.least(F.lit(self._candidates(k, refine)).cast("long"), "own") * one
        return own.select("qid", read.alias("read"), (F.least(F.lit(k).cast("long"), "own") * one).alias("least"), F.lit(n * one).cast("long").alias("whole"))

    def cost(self, query: list[float], k: int, probes: int | None = None, refine: int | None = None) -> tuple[int, int]:
        """(bytes of codes, ids and vectors that `top` needs, bytes of all vectors and ids), as by `costs`."""
        one = self.spark.createDataFrame([("q", [float(x) for x in query])], "vec_id string, embedding array<double>")
        found = self.costs(one, k, probes=probes, refine=refine).first()
        return found["read"], found["whole"]
