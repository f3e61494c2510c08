"""Vector code compression: a code of one byte per part of a vector, from codebooks fitted over all vectors.

A component x becomes the integer floor(1024 * x), so all arithmetic is exact and sums don't depend on their order. A
vector is cut into PARTS consecutive parts. Each part has a codebook of ENTRIES entries, at first the parts of the
smallest vec_ids. In each round a kd-tree over every codebook is broadcast, every vector's parts go to their nearest
entries, and an entry becomes the floor of the mean of its parts.

Search is branch and bound over whole batches: a node is visited by the vectors whose distance to its box is not
greater than their best distance yet. Boxes at just that distance are visited too, as an entry in them may be as near and
have a lower index, which wins a tie.

Scale. The integer vectors are written once and read once a round; a task sends one row per entry that it met, with the
sums of its components, and Spark adds these up. The driver holds the codebooks (PARTS * ENTRIES rows at most).

Defined cases: vectors that are null or hold a null, NaN or infinite component are left out, as are those of another
length than most (ties: the longer length); parts of a length that PARTS doesn't divide differ by one; repeated rows and vec_ids count as
often as they occur (the first codebooks take them by vec_id, then by components); null vec_ids come last and are
returned; rows with a null label are one label; an empty table gives no rows. Components of which squared distances
would not fit 64 bits (beyond about 2 ** 18 at 16 components a part) are refused with a ValueError, as there is no exact result to give.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import batches, stash

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LEAF = 16  # entries of a kd-tree's leaf at most


class Tree:
    """A kd-tree over a codebook's entries; node 0 is the root, a leaf has no children but entries in the order of their indexes."""

    def __init__(self, entries: np.ndarray):
        self.low, self.high, self.children, self.leaf = [], [], [], []
        self._grow(entries, np.arange(len(entries)))
        self.squares = (entries * entries).sum(1)
        self.entries = entries

    def _grow(self, entries: np.ndarray, own: np.ndarray) -> int:
        node = len(self.low)
        low, high = entries[own].min(0), entries[own].max(0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.leaf.append(np.sort(own))
        if len(own) > LEAF and (high - low).max(initial=0) > 0:
            axis = int((high - low).argmax())
            order = own[np.lexsort((own, entries[own, axis]))]
            self.children[node] = (self._grow(entries, order[: len(own) // 2]), self._grow(entries, order[len(own) // 2 :]))
        return node

    def _bound(self, node: int, points: np.ndarray) -> np.ndarray:
        """Squared distances from points to a node's box."""
        out = np.maximum(self.low[node] - points, points - self.high[node])
        np.maximum(out, 0, out=out)
        return (out * out).sum(1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, the lowest index of those at one distance."""
        best = np.full(len(points), np.iinfo(np.int64).max if points.dtype.kind == "i" else np.inf, points.dtype)
        index = np.full(len(points), len(self.entries), np.int64)
        norms = (points * points).sum(1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.children[node] is None:
                own = self.leaf[node]
                d = points[rows] @ (self.entries[own].T * -2) + self.squares[own] + norms[rows, None]
                at = d.argmin(1)
                d, i = d[np.arange(len(rows)), at], own[at]
                better = (d < best[rows]) | (d == best[rows]) & (i < index[rows])
                best[rows[better]], index[rows[better]] = d[better], i[better]
                return
            one, two = self.children[node]
            to_one, to_two = self._bound(one, points[rows]), self._bound(two, points[rows])
            near = to_one <= to_two
            for child, bound, mine in ((one, to_one, near), (two, to_two, ~near), (two, to_two, near), (one, to_one, ~near)):
                visit(child, rows[mine & (bound <= best[rows])])

        visit(0, np.arange(len(points)))
        return index, best


def cuts(length: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [i * length // parts for i in range(parts + 1)]


def _matrix(column, kind) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _assigned(trees, at: list[int], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances): a row per vector, a column per part."""
    found = [tree.nearest(np.ascontiguousarray(points[:, i:j])) for tree, i, j in zip(trees, at, at[1:], strict=False)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(trees, at: list[int], kind):
    """A worker's function: per part and entry that it met, how many parts went there and their sums."""

    def run(parts):
        counts = np.zeros((len(at) - 1, ENTRIES), np.int64)
        sums = [np.zeros((ENTRIES, j - i), np.int64) for i, j in zip(at, at[1:], strict=False)]
        for batch in parts:
            if batch.num_rows:
                points = _matrix(batch.column("v"), kind)
                codes = _assigned(trees.value, at, points)[0]
                whole = points.astype(np.int64)
                for p in range(len(sums)):
                    counts[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                    np.add.at(sums[p], codes[:, p], whole[:, at[p] : at[p + 1]])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array([sums[a][b].tolist() for a, b in zip(p, e, strict=True)], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _coded(trees, at: list[int], kind):
    """A worker's function: each vector's code and error."""

    def run(parts):
        for batch in parts:
            if batch.num_rows:
                codes, errors = _assigned(trees.value, at, _matrix(batch.column("v"), kind))
                text, width = codes.astype(np.uint8).tobytes().hex(), 2 * (len(at) - 1)
                code = [text[i : i + width] for i in range(0, len(text), width)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(errors.sum(1).astype(np.int64))], ["vec_id", "label", "code", "error"])

    return run


def integers(vector: str | Column) -> Column:
    """floor(1024 * x) of every component; null for a vector that is null or holds what is no finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)))


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def fit(vectors: DataFrame, length: int, kind, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of vectors (vec_id, label, v), each an integer array of a row per entry."""
    spark, at = vectors.sparkSession, cuts(length)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    whole = np.array([r["v"] for r in first], np.int64).reshape(len(first), length)
    books = [whole[:, i:j] for i, j in zip(at, at[1:], strict=False)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b.astype(kind)) for b in books])
        met = vectors.select("v").mapInArrow(_sums(trees, at, kind), "part int, entry int, n long, sums array<long>")
        parts = met.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "s"))
        found = parts.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a codebook's components at most
        books = [b.copy() for b in books]
        for r in found:
            if r["place"] is not None:
                books[r["part"]][r["entry"], r["place"]] = r["s"] // r["n"]
        trees.destroy()
    return books


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    batches(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(vector).alias("v")).where("v is not null")
    rows = stash(rows, "codes-vectors")
    widest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    sizes = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), widest.alias("widest")).orderBy(F.desc("n"), F.desc("length")).first()
    out = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if sizes is None:
        return out
    length, at = sizes["length"], cuts(sizes["length"])
    most = (at[-1] - at[-2] or 1) * (2 * ((sizes["widest"] or 0.0) + 1)) ** 2 * 2
    if most >= 2.0**63:
        raise ValueError(f"components of up to {sizes['widest'] / SCALE} have squared distances beyond 64 bits")
    kind = np.float64 if most < 2.0**53 else np.int64  # floats hold integers exactly up to there
    rows = rows.where(F.size("v") == length)
    books = fit(rows, length, kind, rounds)
    trees = spark.sparkContext.broadcast([Tree(b.astype(kind)) for b in books])
    types = dict(rows.dtypes)
    coded = stash(rows.mapInArrow(_coded(trees, at, kind), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "codes")
    totals = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL of `compress` for the table `embeddings`, by full search; sums and distances are exact in doubles."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT vec_id, label, part, CAST(v[(part * len(v)) // {PARTS} + 1 : ((part + 1) * len(v)) // {PARTS}] AS DOUBLE[]) AS s FROM kept, range({PARTS}) r(part))""",
        f"""b0 AS MATERIALIZED (SELECT part, entry, s AS c FROM (SELECT part, s, row_number() OVER (PARTITION BY part ORDER BY vec_id, s) - 1 AS entry FROM cut) WHERE entry < {ENTRIES})""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, label, any_value(s) AS s, min({{'d': list_inner_product(s, s) - 2 * list_inner_product(s, c) + list_inner_product(c, c), 'entry': entry}}) AS m
FROM cut JOIN b{k} USING (part) GROUP BY vec_id, part, label)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT part, entry, list(floor(t / n) ORDER BY place) AS c FROM
(SELECT part, entry, place, sum(x) AS t, count(*) AS n FROM (SELECT part, m.entry AS entry, unnest(s) AS x, generate_subscripts(s, 1) AS place FROM a{k}) GROUP BY ALL) GROUP BY ALL) n USING (part, entry))""")
    steps.append(f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)""")
    steps.append(f"""books AS (SELECT sha256(string_agg(array_to_string(CAST(c AS BIGINT[]), ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"


ORACLE = _oracle()

common.ship(__name__)
