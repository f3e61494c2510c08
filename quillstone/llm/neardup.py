"""Near-duplicate documents by HyperMinHash sketches.

A document is its set of distinct word shingles. One 64-bit hash per shingle feeds a HyperMinHash
sketch: the hash's top bits pick a bucket, and the bucket keeps, of the smallest remainder, the
leading-zero count and ten mantissa bits. Banding over the compressed registers proposes pairs, a
Jaccard estimate corrected for chance register collisions thins them, and the full shingle sets
confirm what is left.

Scale. Texts with equal sets become one class before anything is paired. A band bucket of m classes
proposes m - 1 pairs (each with the bucket's smallest class), not m * m / 2. Links of that first
round join most of a bucket's classes into components; only classes of one bucket that are still in
different components are then compared further, first again with a hub per round, at the end in
blocks of sketches, so every pair of a bucket that could still join two components is looked at and pairs inside a
component are never formed. Of the classes in a surviving pair one text each moves, once.

What is missed. A link is seen if its pair shares a band (not so with probability 3e-6 at Jaccard 0.8, less above) and
its estimate isn't SIGMAS deviations too low (1e-9). With `exact` nothing is missed: in place of bands, documents meet by the
least of their shingle hashes, so many that two sets at the threshold must share one (the prefix filter),
and no pair is dropped by its estimate; that takes a key for every fifth shingle instead of 42 a document.

Defined cases: a null or wordless text has an empty set, n_shingles 0, and links with nothing; a
text with fewer words than the shingle width is one shingle; equal rows and rows that repeat a
doc_id each give a row; a null doc_id takes part but can't name a component, and its row is kept
only if no document of its component has an id; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import (
    _LOWER,
    batches,
    buffer_of,
    frugal,
    mix,
    sequence_hash,
    shingle_hashes,
    slices,
    stash,
    text_bytes,
    unstash,
    word_hashes,
    word_spans,
)

BUCKET_BITS = 8
K = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 6  # registers in a band; 42 bands of 6 miss a pair of Jaccard 0.8 with probability 3e-6
BANDS = K // ROWS
SIGMAS = 6.0  # a pair is dropped unseen only if its estimate is this many deviations too low
HUB_ROUNDS = 2
BLOCK = 1 << 18  # shingles in a block of classes, about 2 MB
SMALL_HUBS = 100_000  # hubs of more than a block whose sizes are broadcast at most

SKETCHED = "doc_id long, h1 long, h2 long, n long, f1 long, f2 long, regs binary, keys array<long>"


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes: leading zeros + 1 above MANTISSA bits; 0 is empty."""
    out = np.zeros(K, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = (hashes[at] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)) >> np.uint64(3)
    part, power = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = 53 - power
    bits = ((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    out[bucket[at]] = ((zeros + 1) << MANTISSA | bits).astype(np.uint16)
    return out


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    low = _LOWER[buf]
    starts, ends, first = word_spans(low, off)
    words = word_hashes(low, starts, ends)
    runs = shingle_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            out.append(sequence_hash(words[a:b])[None])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(own: np.ndarray, percent: int) -> np.ndarray:
    """The least hashes of a sorted set: any set of the threshold's similarity has one of them among its own such."""
    return own[: len(own) - -(-percent * len(own) // 100) + 1]


def _sketch(width: int, percent: int, exact: bool):
    def run(parts):
        for part in parts:
            buf, off = buffer_of(part.column("text"))
            n, f1, f2, regs, keys = [], [], [], [], []
            for i, j in slices(off):
                for own in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width):
                    n.append(len(own))
                    f1.append(own.sum(dtype=np.uint64))
                    f2.append(mix(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                    regs.append(registers(own).tobytes() if len(own) else b"")
                    keys.append(prefix(own, percent).view(np.int64) if exact and len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "h1", "h2", "n", "f1", "f2", "regs", "keys"],
            )

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, K)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of each sketch; an empty register borrows from the next that isn't."""
    at = np.where(regs > 0, np.arange(K), 2 * K)
    wide = np.concatenate([at, at + K], axis=1)
    nearest = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1][:, :K] % K
    full = np.take_along_axis(regs, nearest, axis=1)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), full.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + full[:, :, r])
    return key


def _bands(parts):
    for part in parts:
        keys = band_keys(_matrix(part.column("regs"))).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column("f1"), part.column("f2"), part.column("n"), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))],
            ["f1", "f2", "n", "keys"],
        )


def chance_collision(n: np.ndarray) -> np.ndarray:
    """Probability that two unrelated registers over about n shingles agree: same octave, same mantissa bits."""
    rate = np.asarray(n, float)[..., None] / K
    low = 0.5 ** np.arange(1, 54)
    octave = np.exp(-rate * low) - np.exp(-rate * 2 * low)
    return (octave**2).sum(-1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, registers it rests on) of rows of sketches."""
    seen = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    chance = chance_collision(np.sqrt(np.maximum(na * nb, 1)))
    return (same / np.maximum(seen, 1) - chance) / (1 - chance), seen


def plausible(a, b, na, nb, percent: int, sigmas: float = SIGMAS) -> np.ndarray:
    """Can the pair reach the threshold? By set sizes, which is exact, and by the estimate less `sigmas` deviations."""
    t = percent / 100
    na, nb = np.broadcast_arrays(na, nb)
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    one = [len(x) < len(ok) for x in (a, b)]  # the same sketch against all others
    at = np.flatnonzero(ok)
    a, b = (x if lone else x[at] for x, lone in zip((a, b), one, strict=True))
    seen = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    least = t - sigmas * np.sqrt(t * (1 - t) / seen)
    # The correction only lowers an estimate, so it is worked out for those that are high enough without.
    high = ((a == b) & (a > 0)).sum(-1) >= least * seen
    ok[at[~high]] = False
    at, least = at[high], least[high]
    a, b = (x if lone else x[high] for x, lone in zip((a, b), one, strict=True))
    ok[at] = estimate(a, b, na[at], nb[at])[0] >= least
    return ok


def _thin(percent: int, sigmas: float):
    def run(parts):
        for part in parts:
            na, nb = (np.asarray(part.column(c)) for c in ("an", "bn"))
            ok = plausible(_matrix(part.column("ar")), _matrix(part.column("br")), na, nb, percent, sigmas)
            yield part.select(["a1", "a2", "b1", "b2"]).filter(pa.array(ok))

    return run


def _sets(width: int):
    def run(parts):
        for part in parts:
            buf, off = buffer_of(part.column("text"))
            for i, j in slices(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("f1")[i:j], part.column("f2")[i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                    ["f1", "f2", "set"],
                )

    return run


def _unblock(x, fields: int) -> list:
    """Numpy columns of a block's list of structs: class ids, components, then the rest as Arrow arrays."""
    z = x.values.flatten()
    return [np.stack([np.asarray(z[0]), np.asarray(z[1])], 1), np.stack([np.asarray(z[2]), np.asarray(z[3])], 1), *z[4 : 4 + fields]]


def _block_partners(percent: int, sigmas: float):
    """Of two blocks of one hub's sketches: the classes with a plausible partner in another component."""

    def run(parts):
        for part in parts:
            found = []
            for h1, h2, x, y, same in zip(*(part.column(c) for c in ("h1", "h2", "x", "y", "same")), strict=True):
                fx, cx, nx, rx = _unblock(x, 2)
                fy, cy, ny, ry = (fx, cx, nx, rx) if same.as_py() else _unblock(y, 2)
                rx, ry, nx, ny = _matrix(rx), _matrix(ry), np.asarray(nx), np.asarray(ny)
                hit_x, hit_y = np.zeros(len(fx), bool), np.zeros(len(fy), bool)
                for i in range(len(fx)):
                    far = np.flatnonzero((cy != cx[i]).any(1))
                    far = far[plausible(rx[i][None], ry[far], np.full(len(far), nx[i]), ny[far], percent, sigmas)]
                    hit_y[far] = True
                    hit_x[i] = len(far) > 0
                for hit, f, c, n in [(hit_x | hit_y, fx, cx, nx)] if same.as_py() else [(hit_x, fx, cx, nx), (hit_y, fy, cy, ny)]:
                    hub = np.broadcast_to(np.array([h1.as_py(), h2.as_py()], np.int64), (hit.sum(), 2))
                    found.append(np.concatenate([hub, f[hit], c[hit], n[hit, None]], axis=1))
            rows = np.concatenate(found) if found else np.zeros((0, 7), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(7)], ["h1", "h2", "f1", "f2", "c1", "c2", "n"])

    return run


def _block_links(percent: int, sigmas: float):
    """Of two blocks of classes with their sets: confirmed links that join components, a forest of them.

    A row has blocks x and y (the same one, or two of one hub) with each class's component; pairs
    inside a component, at the start or by a link just found, are passed over.
    """

    def run(parts):
        for part in parts:
            out = []
            for x, y, same in zip(*(part.column(c) for c in ("x", "y", "same")), strict=True):
                same = same.as_py()
                (fx, cx, zx), (fy, cy, zy) = (_unblock(z, 1) for z in (x, x if same else y))
                (nx, sx), (ny, sy) = ((np.diff(np.asarray(z.offsets)), np.asarray(z.flatten()).view(np.uint64)) for z in (zx, zy))
                comp = np.unique(np.concatenate([cx, cy]), axis=0, return_inverse=True)[1].ravel()
                own, other = comp[: len(fx)], comp[len(fx) :]  # views: relabelling one relabels comp
                if own[0] == own.max() == own.min() and (other == own[0]).all():
                    continue
                ends = np.r_[0, np.cumsum(nx)]
                rx = np.stack([registers(sx[ends[i] : ends[i + 1]]) for i in range(len(nx))])
                ey = np.r_[0, np.cumsum(ny)]
                ry = rx if same else np.stack([registers(sy[ey[i] : ey[i + 1]]) for i in range(len(ny))])
                owner = np.repeat(np.arange(len(ny)), ny)
                by = np.argsort(sy, kind="stable")
                sorted_y, owner = sy[by], owner[by]
                for i in range(len(fx)):
                    far = np.flatnonzero(other != own[i])
                    if same:
                        far = far[far > i]
                    if not len(far):
                        continue
                    far = far[plausible(rx[i][None], ry[far], np.full(len(far), nx[i]), ny[far], percent, sigmas)]
                    if not len(far):
                        continue
                    mine = sx[ends[i] : ends[i + 1]]
                    lo, hi = np.searchsorted(sorted_y, mine, "left"), np.searchsorted(sorted_y, mine, "right")
                    at = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum())
                    both = np.bincount(owner[at], minlength=len(ny))[far]
                    for k in far[both * 100 >= (nx[i] + ny[far] - both) * percent]:
                        if other[k] != own[i]:
                            out.append((*fx[i], *fy[k]))
                            comp[comp == other[k]] = own[i]
            cols = [pa.array([r[c] for r in out], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays(cols, ["a1", "a2", "b1", "b2"])

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): smallest node each node can reach over `edges`; only nodes with an edge.

    Alternates large-star and small-star: each round links neighbours to the smallest known node, so
    a hub never gathers its neighbours into one row, and rounds grow with the logarithm of the graph.
    """
    both = lambda e: e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
    e = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Done when every node points at one smaller node that points at none: hubs' links often do at once.
        ends = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", F.lit(None)))
        ends = ends.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.when(F.col("y").isNull(), 1)).alias("under"))
        if ends.where("lo <> hi or (lo is not null and under > 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        near = both(e)
        least = near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = near.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < x").select("x", "m")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")).where("u <> v").distinct()
        last, e = e, stash(small, "edges")
        unstash(last)


#: Bits of the sieve: some for each text that is looked for, between these bounds (32 MB at most).
SIEVE_EACH, SIEVE_LEAST, SIEVE_MOST = 16, 1 << 20, 1 << 28
_MAP = 1 << 15  # bits of one of Spark's bitmaps


def sieved(rows: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """Rows whose `key`, a hash, may be among `needed`'s: a bitmap of bounded size, broadcast, so that most texts needn't move.

    It lets through all that are needed and, as it fills, more of the others; an exact join follows. That has
    to be an inner join after an aggregate: Catalyst moves a semi join below this one, and every text moves.
    """
    size = min(SIEVE_MOST, max(SIEVE_LEAST, 1 << (needed.count() * SIEVE_EACH - 1).bit_length()))
    slot = F.pmod(F.col(key), F.lit(size))
    bits = needed.select(slot.alias("s")).groupBy((F.col("s") / _MAP).cast("int").alias("_map")).agg(F.bitmap_construct_agg(F.col("s") % _MAP).alias("_bits"))
    at = rows.withColumn("_map", (slot / _MAP).cast("int")).withColumn("_p", (slot % _MAP).cast("int"))
    kept = at.join(F.broadcast(bits), "_map")  # size / _MAP rows of 4 kB at most
    return kept.where("shiftright(cast(conv(hex(substring(_bits, _p div 8 + 1, 1)), 16, 10) as int), _p % 8) & 1 = 1").select(rows.columns)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, extra: bool = False, exact: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept (see the module's text for the cases).

    exact: no link is missed, at a higher price. extra: the rows as `keep_one` needs them, with text hashes and components instead of kept.
    """
    spark = docs.sparkSession
    batches(spark)
    sigmas = float("inf") if exact else SIGMAS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(width), "text").alias("h2"), text_bytes().alias("text"))
    sketched = stash(rows.mapInArrow(frugal(_sketch(width, percent, exact)), SKETCHED), "sketched")
    # With an equal set go equal registers, so grouping by them as well changes nothing and stays hashed.
    classes = stash(sketched.where("n > 0").groupBy("f1", "f2", "n", "regs").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("h1", "h2")).alias("at"), F.first("keys").alias("keys")), "classes")
    named = lambda p: F.struct(F.col(f"{p}1").alias("f1"), F.col(f"{p}2").alias("f2")).alias(p)

    # Counts first, with partial sums, then the members of buckets with two classes or more: a bucket with
    # a third of all classes is one row of the counts and a side that the join may split.
    banded = classes.where("n > 3")
    if not exact:
        banded = stash(banded.select("f1", "f2", "n", "regs").mapInArrow(frugal(_bands), "f1 long, f2 long, n long, keys array<long>"), "bands")
    keys = banded.select("f1", "f2", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = stash(keys.join(shared, "key", "left_semi").select("key", "f1", "f2", "n"), "buckets")
    unstash(banded)

    known: list[DataFrame] = []  # sets worked out so far

    def sets_of(needed: DataFrame) -> DataFrame:
        """(f1, f2, set) of the classes (f1, f2) and maybe some others; one text of each class that is new here is read again, by its hash.

        Copies of a text, however many, are one row per partition before anything moves.
        """
        have = reduce(DataFrame.union, known) if known else None
        new = needed if have is None else needed.join(have.select("f1", "f2"), ["f1", "f2"], "left_anti")
        where = stash(new.join(classes, ["f1", "f2"]).select("f1", "f2", F.col("at.h1").alias("h1"), F.col("at.h2").alias("h2")), "wanted")
        texts = sieved(rows, where, "h1").groupBy("h1", "h2").agg(F.first("text").alias("text")).join(where, ["h1", "h2"]).select("f1", "f2", "text")
        known.append(stash(texts.mapInArrow(frugal(_sets(width)), "f1 long, f2 long, set array<long>"), "sets"))
        unstash(where)
        return known[0] if have is None else sieved(reduce(DataFrame.union, known), needed, "f1")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of class pairs (a1, a2, b1, b2), those whose full sets reach the threshold, as structs a, b."""
        side = lambda p: classes.select(F.col("f1").alias(f"{p}1"), F.col("f2").alias(f"{p}2"), F.col("n").alias(f"{p}n"), F.col("regs").alias(f"{p}r"))
        both = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
        left = stash(both.select("a1", "a2", "an", "ar", "b1", "b2", "bn", "br").mapInArrow(frugal(_thin(percent, sigmas)), "a1 long, a2 long, b1 long, b2 long"), "pairs")
        sets = sets_of(left.select(F.col("a1").alias("f1"), F.col("a2").alias("f2")).union(left.select("b1", "b2")).distinct())
        own = lambda p: sets.select(F.col("f1").alias(f"{p}1"), F.col("f2").alias(f"{p}2"), F.col("set").alias(f"{p}s"))
        full = left.join(own("a"), ["a1", "a2"]).join(own("b"), ["b1", "b2"]).withColumn("both", F.size(F.array_intersect("as", "bs")).cast("long"))
        found = stash(full.where(F.col("both") * 100 >= (F.size("as") + F.size("bs") - F.col("both")) * percent).select(named("a"), named("b")), "links")
        unstash(left)
        return found

    def in_blocks(at: DataFrame) -> DataFrame:
        """Links between the components that still meet in a bucket, as structs a, b.

        Buckets with one smallest class go together: most bands of a group of copies share it, so its
        classes are compared once and not once a band.
        """
        at = at.select(F.col("hub.f1").alias("h1"), F.col("hub.f2").alias("h2"), "f1", "f2", F.col("c.f1").alias("c1"), F.col("c.f2").alias("c2")).distinct()
        at = stash(at, "residue")

        def dealt(m: DataFrame, weight) -> DataFrame:
            """With the block of each class among those of its hub, of about BLOCK shingles' weight, by hash; only ids move for it."""
            sized = stash(m.groupBy("h1", "h2").agg(F.ceil(F.sum(weight) / BLOCK).alias("blocks")).where("blocks > 1"), "sized")
            few = sized.count() <= SMALL_HUBS
            m = m.join(F.broadcast(sized) if few else sized, ["h1", "h2"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
            return m.withColumn("block", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")))

        def paired(m: DataFrame, *fields: str) -> DataFrame:
            """Blocks, each with itself and each with those of its hub after it.

            A block goes to each that comes before it by that one's own number, so that a hub's pairs are
            dealt over many tasks.
            """
            m = stash(m.groupBy("h1", "h2", "block", "blocks").agg(F.collect_list(F.struct("f1", "f2", "c1", "c2", *fields)).alias("ms")), "blocks")
            x = m.select("h1", "h2", F.col("block").alias("bx"), F.col("ms").alias("x"), "blocks")
            y = m.where("block > 0").select("h1", "h2", F.col("ms").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("bx"))
            alone = x.where("size(x) > 1").select("h1", "h2", "x", F.slice("x", 1, 0).alias("y"), F.lit(True).alias("same"))
            return alone.union(x.where("bx < blocks - 1").join(y, ["h1", "h2", "bx"]).select("h1", "h2", "x", "y", F.lit(False).alias("same")))

        sketches = paired(dealt(at, F.lit(K // 4)).join(classes.select("f1", "f2", "n", "regs"), ["f1", "f2"]), "n", "regs")
        left = stash(sketches.mapInArrow(frugal(_block_partners(percent, sigmas)), "h1 long, h2 long, f1 long, f2 long, c1 long, c2 long, n long").distinct(), "partners")
        pairs = paired(dealt(left, F.col("n") + 64).join(sets_of(left.select("f1", "f2").distinct()), ["f1", "f2"]), "set")
        found = stash(pairs.mapInArrow(frugal(_block_links(percent, sigmas)), "a1 long, a2 long, b1 long, b2 long").select(named("a"), named("b")), "links")
        unstash(at, left)
        return found

    def labelled(comps: DataFrame | None, turn: int) -> DataFrame:
        """(key, f1, f2, n, c, hub) of buckets where components meet: each class's component and the bucket's hub of this turn."""
        at = buckets.withColumn("f", F.struct("f1", "f2"))
        if comps is not None:
            at = at.join(comps.withColumnRenamed("node", "f"), "f", "left")
        at = at.withColumn("c", F.coalesce("comp", "f") if comps is not None else F.col("f")).select("key", "f1", "f2", "n", "c")
        order = F.xxhash64(F.lit(turn), "f1", "f2") if 0 < turn < HUB_ROUNDS else F.lit(0).cast("long")
        hub = F.min(F.struct(order.alias("o"), "f1", "f2", "n", "c")).alias("hub")
        met = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), hub).where("lo <> hi").select("key", "hub")
        return at.join(met, "key")

    links: list[DataFrame] = []
    comps = None
    for turn in range(HUB_ROUNDS + 1):
        at = labelled(comps, turn)
        if turn < HUB_ROUNDS:
            me, it = F.struct("f1", "f2"), F.struct("hub.f1", "hub.f2")
            alike = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent  # else the sets' sizes rule it out
            at = at.where("hub.c <> c").where(alike).select(F.least(me, it).alias("a"), F.greatest(me, it).alias("b")).distinct()
            found = confirmed(at.select(F.col("a.f1").alias("a1"), F.col("a.f2").alias("a2"), F.col("b.f1").alias("b1"), F.col("b.f2").alias("b2")))
        else:
            found = in_blocks(at)
        if not found.isEmpty():
            links.append(found)
            last, comps = comps, stash(components(reduce(DataFrame.union, links), "a", "b"), "components")
            unstash(last)
    unstash(buckets, *known, *links)

    of = classes.select("f1", "f2", "doc_id").withColumn("f", F.struct("f1", "f2"))
    if comps is not None:
        of = of.join(comps.withColumnRenamed("node", "f"), "f", "left").withColumn("comp", F.coalesce("comp", "f"))
        of = of.join(of.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("f1", "f2", "comp", "component_id")
    else:
        of = of.select("f1", "f2", F.col("f").alias("comp"), F.col("doc_id").alias("component_id"))
    if extra:
        return sketched.select("doc_id", "h1", "h2", F.col("n").alias("n_shingles"), "f1", "f2").join(of, ["f1", "f2"], "left").drop("f1", "f2")
    out = sketched.select("doc_id", "n", "f1", "f2").join(of, ["f1", "f2"], "left")
    mine = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, mine.isNull()).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs`, all columns: one of each component, and those without words; repeats of a kept row's id go too.

    A component's row is the one of its smallest doc_id (of equal ids the first by text, of equal texts by the row as JSON); components
    without any id keep one row. Of rows without words all that have no id stay.
    """
    found = near_duplicates(docs, width, percent, extra=True)
    best = found.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("m")).select("m.doc_id", "m.h1", "m.h2", F.lit(False).alias("all"))
    bare = found.where("n_shingles = 0").select("doc_id", "h1", "h2", F.col("doc_id").isNull().alias("all")).distinct()
    key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("none"))
    keep = stash(best.union(bare).select(key(F.col("doc_id")).alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("all").alias("_all")), "keep")
    text = F.coalesce("text", F.lit(""))
    # Own names for all columns meanwhile, so that none of the table's can clash.
    own = docs.select(F.struct("*").alias("_row"), key(F.col("doc_id")).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(width), text).alias("_h2"))
    kept = own.join(keep, ["_id", "_h1", "_h2"]).withColumn("_each", F.when(F.col("_all"), F.monotonically_increasing_id()))
    return kept.groupBy("_id", "_h1", "_h2", "_each").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")


common.ship(__name__)
