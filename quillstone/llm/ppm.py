"""Language-model scores by prediction with partial matching (PPM).

A byte-context trie of order 5, learned from the training rows, gives each byte of a text a code
length: the deepest context that knows the byte codes it, every deeper one that doesn't pays an
escape (method C: a context seen n times with d distinct bytes escapes with d / (n + d)), and bytes
that an escaped context knows are excluded from the shallower ones. The trie is frozen while
scoring, so a byte's code length depends on its last six bytes alone. Text is coded in UTF-8 with
A-Z lower-cased; 0xFE stands for the start of the text and 0xFF for its end, neither occurs in UTF-8.

Scale. The trie is a table of (context and byte, count), never held in one place. Documents are dealt,
as they are scanned, into groups of a bounded number of bytes and of distinct strings, and written down so, as which group a row is
in must not change when a lost executor's work is done again. Each group sends its distinct 6-byte
strings and words with their training counts, the counts are summed by key, code lengths are worked out in subtrees of one
three-byte context (at most 256 ** 3 rows, by the size of the alphabet), and each group gets back
only the rows of its own strings, for which its text moves once. Only the orders below 3 go to every task: at most 256 ** 3 counts by
the size of the alphabet, some ten thousand in practice.

Words are counted by a 64-bit hash of their bytes; two of a billion distinct words share one with a
probability of about 3 %.

Defined cases: a null text is empty and is scored as an end alone; a null doc_id counts as the empty
text for the split; repeated rows are each learned from and each scored; with no training rows N and
V are 0 and the model is uniform over 256 bytes; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import _LOWER, SLICE_BYTES, batches, buffer_of, release, remainder, slices, stash, text_bytes, word_hashes, word_spans

ORDER = 5
ROOT = 3
GROUP_BYTES = 32 << 20
#: Distinct strings of a group, estimated; scoring takes about 100 bytes for each.
MOST_STRINGS = 4_000_000
#: Partitions that groups are dealt over at most; each takes its groups one after the other.
MOST_PARTITIONS = 20_000
_ROWS = 200_000  # of an Arrow batch of keys
START, END = 0xFE, 0xFF
GRAM, WORD = 0, 1
#: The end token's key among words; a word's hash takes this value with probability 2 ** -64.
END_KEY = np.uint64(0x8000000000000000)


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first key per document): per byte and end of text, the last ORDER bytes and itself."""
    m, n = len(off) - 1, len(buf)
    pad = ORDER + 1
    text = np.full(n + pad * m, START, np.uint8)
    lens = np.diff(off)
    keep = np.ones(len(text), bool)
    begins = off[:-1] + pad * np.arange(m)
    keep[(begins[:, None] + np.arange(ORDER)).ravel()] = False
    ends = begins + ORDER + lens
    body = keep.copy()
    body[ends] = False
    text[body] = buf
    text[ends] = END
    key = np.zeros(len(text) - ORDER, np.uint64)
    for i in range(pad):
        key <<= np.uint64(8)
        key |= text[i : len(text) - ORDER + i]
    return key[keep[ORDER:]], off + np.arange(m + 1)


def gram_pieces(buf: np.ndarray, off: np.ndarray):
    """`grams`, in steps of SLICE_BYTES for a single long document."""
    n = len(buf)
    if len(off) != 2 or n <= 2 * SLICE_BYTES:
        yield grams(buf, off)
        return
    for a in range(0, n, SLICE_BYTES):
        b = min(a + SLICE_BYTES, n)
        head = buf[a - ORDER : a] if a else np.full(ORDER, START, np.uint8)
        text = np.concatenate([head, buf[a:b], np.full(int(b == n), END, np.uint8)])
        key = np.zeros(len(text) - ORDER, np.uint64)
        for i in range(ORDER + 1):
            key <<= np.uint64(8)
            key |= text[i : len(text) - ORDER + i]
        yield key, np.array([0, len(key)])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(buf, off)
    return word_hashes(buf, starts, ends), first


def _spread(train: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.repeat(train, np.diff(first))


def _packed(batch: pa.RecordBatch) -> bytes:
    """Rows as one compressed value: text is kept once and moved once, and takes a third of its size so."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(column):
    """The record batches of a column of `_packed`."""
    for value in column:
        yield from pa.ipc.open_stream(value.as_buffer())


def _sampled(buf: np.ndarray) -> np.ndarray:
    """A 64th of the distinct strings of ORDER + 1 bytes, by their hash: counted, they tell how many there are."""
    if len(buf) <= ORDER:
        return np.zeros(0, np.uint64)
    low, key = _LOWER[buf], np.zeros(len(buf) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        key <<= np.uint64(8)
        key |= low[i : len(buf) - ORDER + i]
    return np.unique(key[(key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58) == 0])


def _deal(limit: int, strings: int = MOST_STRINGS):
    """(group, its rows packed): a partition's rows in order, about `limit` bytes of text a group and about `strings` distinct strings at most.

    The latter are what a group's memory goes by: prose has few, random text as many as bytes. One document is never cut.
    """

    def run(parts):
        from pyspark import TaskContext

        group, used, seen = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.uint64)
        for part in parts:
            buf, off = buffer_of(part.column("text"))
            start = 0
            for i, j in slices(off):
                own = [_sampled(buf[p : p + SLICE_BYTES + ORDER]) for p in range(int(off[i]), int(off[j]), SLICE_BYTES)]
                new, size = np.unique(np.concatenate([seen, *own])), int(off[j] - off[i]) + 64 * (j - i)
                if used and (used + size > limit or len(new) * 64 > strings):
                    if i > start:
                        yield _dealt(group, part.slice(start, i - start))
                    group, used, start = group + 1, 0, i
                    new = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
                used, seen = used + size, new
            if part.num_rows > start:
                yield _dealt(group, part.slice(start))

    return run


def _dealt(group: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([_packed(rows)], pa.binary())], ["g", "rows"])


def _table(g: int, got: dict):
    """A group's keys and counts as Arrow batches."""
    for kind, parts in got.items():
        keys, counts = _merged(parts)
        for i in range(0, len(keys), _ROWS):
            k, c = keys[i : i + _ROWS], counts[i : i + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["g", "kind", "key", "c"])


def _tally(parts):
    """Distinct strings and words of each group of documents, with their counts in its training rows.

    A group that lies in several partitions' rows gives some keys more than once, with parts of their counts.
    """
    now, got = None, {}
    for part in parts:
        for g, own in ((g, own) for g, value in zip(part.column("g").to_pylist(), part.column("rows"), strict=True) for own in _unpacked([value])):
            if now != g:
                if got:
                    yield from _table(now, got)
                    release()
                now, got = g, {GRAM: [], WORD: []}
            train = ~np.asarray(own.column("held").to_numpy(zero_copy_only=False), bool)
            buf, off = buffer_of(own.column("text"))
            got[WORD].append((END_KEY[None], train.sum(keepdims=True)))
            for i, j in slices(off):
                low, at = _LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                for kind, made in ((GRAM, gram_pieces(low, at)), (WORD, [_words(low, at)])):
                    for keys, first in made:
                        learn = _spread(train[i:j], first)
                        a, n = _counted(keys[learn])
                        b, _ = _counted(keys[~learn])
                        got[kind].append((np.concatenate([a, b]), np.concatenate([n, np.zeros(len(b), n.dtype)])))
                        if len(got[kind]) >= 8:
                            got[kind] = [_merged(got[kind])]
    if got:
        yield from _table(now, got)
        release()


class _Ladder:
    """Counts per order, from `top` down to `bottom`, of distinct strings that make up whole subtrees.

    Of each order: the distinct strings, their counts, each string's context with the context's total
    and number of distinct bytes, and where the string without its oldest byte is one order below.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray, top: int, bottom: int):
        self.steps = []
        for k in range(top, bottom - 1, -1):
            own, inverse = np.unique(strings & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(inverse, counts, len(own)).astype(np.int64)
            if self.steps:
                self.steps[-1]["below"] = inverse
            else:
                self.top = inverse
            at = np.flatnonzero(np.r_[True, (own[1:] >> np.uint64(8)) != (own[:-1] >> np.uint64(8))][: len(own)])
            ctx = np.repeat(np.arange(len(at)), np.diff(at, append=len(own)))
            n, d = np.add.reduceat(counts, at), np.add.reduceat((counts > 0).astype(np.int64), at)
            self.steps.append({"own": own, "c": counts, "ctx": ctx, "n": n, "d": d})
            strings = own


def code_lengths(keys: np.ndarray, c: np.ndarray, low: _Ladder) -> np.ndarray:
    """log10 probability of the last byte of each string of ORDER + 1 bytes after the others.

    keys: distinct strings that make up whole subtrees of ROOT-byte contexts, c: their training
    counts, low: the orders below ROOT over the whole training text.
    """
    high = _Ladder(keys, c, ORDER, ROOT)
    last = high.steps[-1]
    last["below"] = np.searchsorted(low.steps[0]["own"], last["own"] & np.uint64((1 << 8 * ROOT) - 1))
    steps = high.steps + low.steps
    out, left, at = np.zeros(len(keys)), np.ones(len(keys), bool), high.top
    gone_n = gone_d = np.zeros(len(keys), np.int64)  # what the escaped context excludes here
    for step, under in zip(steps, [*steps[1:], None], strict=True):
        ctx = step["ctx"][at]
        count, n, d = step["c"][at], step["n"][ctx], step["d"][ctx]
        free_n, free_d = n - gone_n, d - gone_d
        whole = np.maximum(free_n + free_d, 1)
        hit = left & (count > 0)
        out[hit] += np.log10(count[hit] / whole[hit])
        left &= ~hit
        miss = left & (n > 0) & (free_d > 0)
        out[miss] += np.log10(free_d[miss] / whole[miss])
        gone_d = d
        if under:
            known = np.where(step["c"] > 0, under["c"][step["below"]], 0)
            gone_n = np.bincount(step["ctx"], known, len(step["n"])).astype(np.int64)[ctx]
            at = step["below"][at]
    out[left] -= np.log10(256 - gone_d[left])
    return out


def _subtrees(low: _Ladder):
    """Arrow batches sorted by root context -> code lengths, holding one subtree (and a batch) at a time."""

    def run(parts):
        keys, c, held = [], [], 0

        def flush(keys, c):
            cost = code_lengths(keys, c, low)
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), pa.array(cost[i : i + 50_000])], ["key", "value"])

        for part in parts:
            if not part.num_rows:
                continue
            keys.append(np.asarray(part.column("key")).view(np.uint64))
            c.append(np.asarray(part.column("c")))
            held += part.num_rows
            if held >= 1 << 18:
                k, n = np.concatenate(keys), np.concatenate(c)
                root = k >> np.uint64(8) & np.uint64((1 << 8 * ROOT) - 1)
                cut = int(np.flatnonzero(root != root[-1])[-1]) + 1 if (root != root[-1]).any() else 0
                if cut:
                    yield from flush(k[:cut], n[:cut])
                keys, c, held = [k[cut:]], [n[cut:]], len(k) - cut
        if held:
            yield from flush(np.concatenate(keys), np.concatenate(c))

    return run


class _Lookup:
    """Open-addressing table from 64-bit keys to values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(math.ceil(math.log2(max(len(keys), 1) * 4))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = np.append(keys, np.uint64(0)), np.append(values, 0.0)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of `keys`; one that isn't in the table is an error."""
        slot = self._slot(keys)
        got = self.at[slot]
        wrong = np.flatnonzero((got < 0) | (self.keys[got] != keys))
        while len(wrong):
            if (got[wrong] < 0).any():
                raise KeyError("a group's model lacks one of its strings")
            slot[wrong] = (slot[wrong] + 1) & self.mask
            got[wrong] = self.at[slot[wrong]]
            wrong = wrong[(got[wrong] < 0) | (self.keys[got[wrong]] != keys[wrong])]
        return self.values[got]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some])
    return out


def _score(total: int, distinct: int):
    def run(key, docs, model):
        kind, keys, value = (model.column(c).combine_chunks().to_numpy() for c in ("kind", "key", "value"))
        keys = keys.view(np.uint64)
        cost, count = (_Lookup(keys[kind == k], value[kind == k]) for k in (GRAM, WORD))
        unit = math.log10(total + distinct + 1)
        end_count = count(END_KEY[None])[0] if docs.num_rows else 0
        end, known_end = math.log10(end_count + 1) - unit, int(end_count > 0)
        cols = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        ids, held = [], []
        for own in _unpacked(docs.column("rows")):
            ids.append(own.column("doc_id"))
            held.append(own.column("held"))
            buf, off = buffer_of(own.column("text"))
            for i, j in slices(off):
                low, at = _LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                cols["score"].append(sum(_sums(cost(strings), first) for strings, first in gram_pieces(low, at)))
                words, first = _words(low, at)
                c = count(words)
                cols["n_tokens"].append(np.diff(first) + 1)
                cols["n_known"].append(_sums((c > 0).astype(float), first).astype(np.int64) + known_end)
                cols["base_score"].append(_sums(np.log10(c + 1) - unit, first) + end)
        out = {c: pa.array(np.concatenate(v)) if v else pa.array([], pa.float64()) for c, v in cols.items()}
        del cost, count, kind, keys, value
        release()
        n = sum(map(len, ids))
        return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "held_out": pa.chunked_array(held, pa.bool_()), "n_tokens": out["n_tokens"].cast(pa.int64()), "n_known": out["n_known"].cast(pa.int64()), "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": out["base_score"], "score": out["score"]})

    return run


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id) mod `folds` is `held_fold` are scored but not learned from.
    """
    batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", folds) == held_fold).alias("held"), text_bytes().alias("text"))
    dealt = stash(rows.mapInArrow(_deal(GROUP_BYTES), "g long, rows binary"), "dealt")
    tallied = stash(dealt.mapInArrow(_tally, "g long, kind byte, key long, c long"), "tallied", "zstd")
    groups = max(1, min(MOST_PARTITIONS, tallied.select("g").distinct().count()))
    model = stash(tallied.groupBy("kind", "key").agg(F.sum("c").alias("c")), "model", "zstd")
    words, strings = model.where(f"kind = {WORD}"), model.where(f"kind = {GRAM}")
    known = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct")).first()
    pairs = strings.groupBy((F.col("key") % (1 << 8 * ROOT)).alias("key")).agg(F.sum("c").alias("c")).toArrow()  # 256 ** ROOT rows at most
    low = _Ladder(np.asarray(pairs["key"]).view(np.uint64), np.asarray(pairs["c"]), ROOT - 1, 0)
    root = F.shiftright("key", 8) % (1 << 8 * ROOT)
    priced = strings.withColumn("root", root).repartition("root").sortWithinPartitions("root").select("key", "c").mapInArrow(_subtrees(low), "key long, value double")
    priced = priced.select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value").union(words.select("kind", "key", F.col("c").cast("double")))
    table = tallied.select("g", "kind", "key").join(priced, ["kind", "key"]).select("g", "kind", "key", "value")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    sides = (x.repartition(groups, "g").groupBy("g") for x in (dealt, table))
    return next(sides).cogroup(next(sides)).applyInArrow(_score(known["total"], known["distinct"]), kinds)


common.ship(__name__)
