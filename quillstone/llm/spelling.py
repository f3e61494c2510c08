"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each is a variant of.

All words lie in a trie, which is cut into heavy paths: of a node's children the one with most words is heavy, the others are
light. Two words that differ by one edit part at one node, below which at least one of them is in a light child.
So each word is merged, with that node's character skipped, replaced or one inserted, into its siblings, but only from
light children, that is at most log2(words) times: skipped, it may end where any word ends; with the heavy child's
character inserted or put in its place, where a word of the heavy child ends; and two words of light children meet
where both have their character left open. Every pair is found at one node, in one way.

Scale. Words are counted in batches before they are shuffled. The trie's top, nodes with more than GROUP words or
GROUP_BYTES bytes below them, is worked out level by level as joins: at each such node the edited words of its light children
are joined with all words. What is below is dealt to tasks, each with a small trie of its own. Of the top only
its nodes' heavy children are broadcast: each node has more than GROUP words below it, so they are few. Nothing
grows with the square of a group: words that share what is left open differ in one character, so they are no more than the alphabet.

Defined cases: a null text has no words; a null id is the empty text before the colon; repeated rows count as often as they
occur; a word of any length is taken whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import _LOWER, SLICE_BYTES, batches, buffer_of, frugal, slices, stash, text_bytes

SHORTEST, TIMES, DELETE = 7, 2, 31
RATIO = 10  # a form occurs so many times as often
GROUP, GROUP_BYTES = 50_000, 8 << 20
_LONG = 48  # bytes of a run up to which checksums are worked out for many at a time

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letter_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and lengths in code points of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, which are a byte C3 and one after."""
    wide = buf == 0xC3
    ink = _LETTER[buf] | wide
    ink[1:] |= wide[:-1]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    wides = np.flatnonzero(wide)
    return starts, ends, (ends - starts) - (np.searchsorted(wides, ends) - np.searchsorted(wides, starts))


def _steps(buf: np.ndarray, off: np.ndarray):
    """(documents' first row, bytes, offsets) in steps of about SLICE_BYTES; a longer document is cut where no run goes on."""
    for i, j in slices(off):
        at, end = int(off[i]), int(off[j])
        if j - i > 1 or end - at <= 2 * SLICE_BYTES:
            yield i, buf[at:end], off[i : j + 1] - at
            continue
        while at < end:
            cut = min(at + SLICE_BYTES, end)
            while cut < end:  # on to the next byte that is no letter's
                near = buf[cut - 1 : cut + SLICE_BYTES]
                gap = np.flatnonzero(~(_LETTER[near[1:]] | (near[1:] == 0xC3) | (near[:-1] == 0xC3)))
                if len(gap):
                    cut += int(gap[0])
                    break
                cut = min(cut + SLICE_BYTES, end)
            yield i, buf[at:cut], np.array([0, cut - at])
            at = cut


#: The table of a checksum's steps, from the checksums of single bytes.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of what each run's `before` is the crc32 of, followed by the run; many runs a byte at a time."""
    out = np.zeros(len(starts), np.int64)
    size = ends - starts
    for k in np.flatnonzero(size > _LONG):
        out[k] = zlib.crc32(buf[starts[k] : ends[k]].tobytes(), int(before[k]))
    own = np.flatnonzero(size <= _LONG)
    own = own[np.argsort(-size[own], kind="stable")]
    state = before[own].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    n = np.searchsorted(-size[own], -np.arange(1, _LONG + 1), "right")  # runs with so many bytes or more
    for k, m in enumerate(n):
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ buf[starts[own[:m]] + k]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[own] = state ^ np.uint32(0xFFFFFFFF)
    return out


def without(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def _counted(parts):
    """(word, n) of batches of (doc_id as bytes, text as bytes), words as Latin-1 bytes, added up a step at a time."""
    for batch in parts:
        if not batch.num_rows:
            continue
        ids = [zlib.crc32((i or b"") + b":") for i in batch.column("doc_id").to_pylist()]
        buf, off = buffer_of(batch.column("text"))
        for row, data, offsets in _steps(buf, off):
            starts, ends, length = letter_runs(data, offsets)
            keep = length >= SHORTEST
            starts, ends, length = starts[keep], ends[keep], length[keep]
            if not len(starts):
                continue
            low = _LOWER[data]
            doc = np.searchsorted(offsets, starts, "right") - 1 + row
            h = checksums(low, starts, ends, np.array(ids, np.int64)[doc])
            bounds = np.stack([starts, ends], 1).ravel().astype(np.int32)
            every = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(low.tobytes())])
            runs = every.take(pa.array(np.arange(0, len(bounds), 2)))
            cut = h % DELETE == 0
            shorter = np.flatnonzero(cut & (length > SHORTEST))
            edited = [without(w, p) for w, p in zip(runs.take(pa.array(shorter)).to_pylist(), (h[shorter] % length[shorter]).tolist(), strict=True)]
            words = pa.concat_arrays([runs.filter(pa.array(~cut)), pa.array(edited, pa.string())])
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.array([w.encode("latin-1") for w in counts.field(0).to_pylist()], pa.binary()), counts.field(1)], ["word", "n"])


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the words of documents (doc_id, text) of SHORTEST code points or more with how often they occur, TIMES at least; words as Latin-1 bytes."""
    batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(frugal(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def common_start(a: bytes, b: bytes) -> int:
    """How many bytes two words begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # alike up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def one_edit_pairs(words: list[bytes]):
    """Pairs (a, b) of different `words`, which are sorted, that differ by one edit, each once: a trie's nodes from the words' common starts."""
    known = set(words)

    def merged(depth: int, starts: list[int], end: int):
        sizes = [b - a for a, b in zip(starts, [*starts[1:], end], strict=True)]
        heavy = max(range(len(sizes)), key=sizes.__getitem__)
        h = words[starts[heavy]][depth : depth + 1]
        left_open: dict[bytes, list[bytes]] = {}
        for k, (first, size) in enumerate(zip(starts, sizes, strict=True)):
            if k == heavy:
                continue
            for w in words[first : first + size]:
                start, own, rest = w[:depth], w[depth : depth + 1], w[depth + 1 :]
                if h:
                    found = start + h + own + rest
                    if found in known:
                        yield w, found
                if not own:
                    continue
                found = start + rest
                if found in known and rest[:1] != own:
                    yield w, found
                if h:
                    replaced = start + h + rest
                    if replaced in known:
                        yield w, replaced
                others = left_open.setdefault(found, [])
                for o in others:
                    yield w, o
                others.append(w)

    open_: list[tuple[int, list[int]]] = []
    for i in range(1, len(words) + 1):
        alike = common_start(words[i - 1], words[i]) if i < len(words) else -1
        start = i - 1
        while open_ and open_[-1][0] > alike:
            depth, starts = open_.pop()
            yield from merged(depth, starts, i)
            start = starts[0]
        if alike < 0:
            break
        if open_ and open_[-1][0] == alike:
            open_[-1][1].append(i)
        else:
            open_.append((alike, [start, i]))


_PAIR = "a binary, b binary"


def _grouped(parts):
    """Pairs within each group of batches (g, word) sorted by both."""

    def done(words):
        pairs = list(one_edit_pairs(words))
        for i in range(0, len(pairs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs[i : i + 10_000], strict=True)], ["a", "b"])

    group, words = None, []
    for batch in parts:
        for g, w in zip(batch.column("g").to_pylist(), batch.column("word").to_pylist(), strict=True):
            if g != group:
                yield from done(words)
                group, words = g, []
            words.append(w)
    yield from done(words)


def _alike(low: pd.Series, high: pd.Series) -> pd.Series:
    """Common starts of two binary columns."""
    return pd.Series([common_start(bytes(a), bytes(b)) for a, b in zip(low, high, strict=True)], dtype="int32")


def pairs(words: DataFrame, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b): all pairs of `words` (word: distinct Latin-1 bytes) that differ by one edit, each in one order."""
    alike = F.pandas_udf(_alike, "int")
    at = lambda c, i, n=None: F.substring(c, i, F.lit(2**31 - 1) if n is None else n)
    waiting, settled, found = stash(words.select("word", F.lit("").alias("g")), "spelling"), [], []
    known = waiting.select(F.col("word").alias("b"))
    while True:
        of = waiting.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.length("word").cast("long")).alias("bytes"), F.min("word").alias("low"), F.max("word").alias("high"))
        big = of.where((F.col("n") > 1) & ((F.col("n") > group) | (F.col("bytes") > group_bytes)))
        big = stash(big.select("g", alike("low", "high").alias("d")), "spelling-nodes")
        if not big.limit(1).count():
            break
        # A node of the top has more than `group` words or `group_bytes` bytes below it, so nodes are few: a row of 40 bytes each.
        settled.append(waiting.join(F.broadcast(big.select("g")), "g", "left_anti"))
        below = waiting.join(F.broadcast(big), "g").withColumn("own", at("word", F.col("d") + 1, F.lit(1)))
        heavy = below.groupBy("g", "own").agg(F.count("*").alias("n")).groupBy("g").agg(F.min(F.struct(-F.col("n"), F.col("own"))).getField("own").alias("h"))
        below = stash(below.join(F.broadcast(heavy), "g"), "spelling-top")
        light = below.where("own <> h").select("g", "d", F.col("word").alias("a"), "own", "h", at("word", F.lit(1), F.col("d")).alias("start"), at("word", F.col("d") + 2).alias("rest"))
        ends, named = F.length("own") == 0, F.length("h") > 0
        skipped = F.when(~ends & (F.substring("rest", 1, 1) != F.col("own")), F.concat("start", "rest"))
        edits = light.select("a", F.explode(F.array(skipped, F.when(named, F.concat("start", "h", "own", "rest")), F.when(named & ~ends, F.concat("start", "h", "rest")))).alias("b"))
        found.append(edits.where("b is not null").join(known, "b").select("a", "b"))
        # Words of one node with the same rest differ in one character, so such a group is no larger than the alphabet.
        same = light.where(~ends).groupBy("g", "rest").agg(F.sort_array(F.collect_list("a")).alias("w")).where(F.size("w") > 1)
        both = same.select("w", F.posexplode("w").alias("i", "a")).select("a", F.explode(F.slice("w", F.col("i") + 2, F.greatest(F.size("w") - F.col("i") - 1, F.lit(0)))).alias("b"))
        found.append(both)
        waiting = stash(below.where(~(F.length("own") == 0)).select("word", F.md5(at("word", F.lit(1), F.col("d") + 1)).alias("g")), "spelling")
    settled.append(waiting)
    groups, *more = settled
    for other in more:
        groups = groups.unionByName(other)
    out = groups.select("g", "word").repartition("g").sortWithinPartitions("g", "word").mapInArrow(frugal(_grouped), _PAIR)
    for other in found:
        out = out.unionByName(other)
    return out


def variants(docs: DataFrame, ratio: int = RATIO, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stash(words_of(docs), "words")
    one = stash(pairs(words, group, group_bytes), "spelling-pairs")
    near = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = near.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    often = -F.col("best.m") >= F.col("n") * ratio
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.b")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n"))
    rows = stash(rows, "forms")
    # A form occurs `ratio` times as often, so ways to a root are short; each round halves them.
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stash(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")), "roots")
        links = step.select("word", "root")
        if not step.where("_on").limit(1).count():
            break
    text = lambda c: F.decode(c, "ISO-8859-1")
    return rows.join(links, "word", "left").select(text("word").alias("word"), text("form").alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL of `variants` for the table `documents`: crc32 a byte at a time, near words by what is left when a character goes.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
kinds AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM runs WHERE length(w) >= {SHORTEST} GROUP BY id, w),
summed AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS h FROM kinds, crc),
words AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {DELETE} = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, n FROM summed) WHERE length(w) >= {SHORTEST} GROUP BY w HAVING sum(n) >= {TIMES}),
gaps AS MATERIALIZED (SELECT w, i, left(w, i) || substr(w, i + 2) AS d FROM words, LATERAL (SELECT unnest(range(length(w))) AS i)),
near AS MATERIALIZED (SELECT a.w AS a, b.w AS b FROM gaps a JOIN gaps b ON a.d = b.d AND a.i = b.i AND a.w <> b.w UNION SELECT g.w, v.w FROM gaps g JOIN words v ON g.d = v.w UNION SELECT v.w, g.w FROM gaps g JOIN words v ON g.d = v.w),
best AS (SELECT a, count(*) AS n_near, min({{'m': -n, 'b': b}}) AS o FROM near JOIN words ON w = b GROUP BY a),
forms AS MATERIALIZED (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -o.m >= {RATIO} * n THEN o.b END AS form, CASE WHEN -o.m >= {RATIO} * n THEN -o.m END AS form_n FROM words LEFT JOIN best ON a = w),
way AS (SELECT w, w AS root FROM forms UNION ALL SELECT way.w, f.form FROM way JOIN forms f ON f.w = way.root WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, way.root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.w = f.w JOIN forms e ON e.w = way.root WHERE e.form IS NULL"""

common.ship(__name__)
