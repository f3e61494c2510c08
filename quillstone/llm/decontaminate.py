"""Benchmark decontamination by q-gram lemma filtering.

Every WINDOW bytes of an item, at all places, are a window (whole items where they are shorter). A
stretch of text within e edits of a window of n bytes shares at least n + 1 - Q * (e + 1) q-grams with
it, all near one diagonal (place in the text minus place in the item). So q-grams shared with whole
items are counted in overlapping bands of diagonals; where a window's places in a band reach the bound,
a banded alignment verifies the window. Text and items are compared with A-Z lower-cased and each run of
white space as one blank. An item of so few bytes that no edit is allowed must be met as whole words, that is
runs of letters and digits, whatever is between them; it is looked up by the 64-bit hash of its words.

Scale. One pass over the documents, without a shuffle. The items' index, some 16 bytes for a byte of item
text, goes to every task; it is built from about BLOCK_BYTES of item text at a time, and larger benchmarks are
passed block by block within the same scan.

Defined cases: null and empty texts are clean; items without words match nothing; items of equal text all match; an
empty benchmark leaves all rows clean; repeated rows each give a row; a null item_id is not reported, but its text
contaminates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import _LOWER, _SPACE, batches, buffer_of, frugal, mix, shingle_hashes, slices, text_bytes, word_hashes, word_spans

Q = 10
WINDOW = 96  # bytes; about fifteen words
EDITS = 0.06  # of a window's bytes
BATCH = 256  # windows aligned at a time
BLOCK_BYTES = 4 << 20
HITS = 1 << 18  # shared q-grams looked at together, about
STEP = 1 << 18  # bytes of text normalised and hashed at a time, as its arrays take some 40 times as much
REACH = 256  # bytes; no window's shared q-grams lie further apart
_BLOOM = 22


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single blanks, and the documents' new offsets."""
    low = _LOWER[buf]
    blank = _SPACE[low]
    low[blank] = 0x20
    drop = blank.copy()
    drop[1:] &= blank[:-1]
    if len(buf):
        drop[0] = False
    heads = off[:-1][(off[:-1] > 0) & (off[:-1] < len(buf))]
    drop[heads] = False
    keep = ~drop
    sizes = [np.count_nonzero(keep[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return low[keep], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q bytes."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = buf.astype(np.uint64)
    two = b[:-1] << np.uint64(8) | b[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:n] << np.uint64(32) | four[4 : n + 4]
    eight *= np.uint64(0x9E3779B97F4A7C15)
    eight ^= eight >> np.uint64(29)
    eight += two[8 : n + 8]
    eight *= np.uint64(0xBF58476D1CE4E5B9)
    return eight


_INK = np.zeros(256, bool)
_INK[48:58] = _INK[97:123] = _INK[128:] = True


def _plain_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of letters and digits, first per document) of lower-cased texts."""
    plain = np.where(_INK[buf], buf, np.uint8(0x20))
    starts, ends, first = word_spans(plain, off)
    return word_hashes(plain, starts, ends), first


def _sequences(words: np.ndarray, k: int) -> np.ndarray:
    return words if k == 1 else shingle_hashes(words, k)


class Index:
    """The items' bodies and where each q-gram is in them.

    Any WINDOW bytes of an item, from whatever place, are a window (an item that is shorter is its own).
    """

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items, self.bodies, short = [], [], {}
        hashes, sizes = [], []
        for item_id, text in items:
            buf, off = normalised(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            bare = buf.tobytes().strip(b" ")
            if len(bare) * EDITS < 1:
                words, _ = _plain_words(buf, off)
                if len(words):
                    short.setdefault(len(words), []).append((int(_sequences(words, len(words))[0]), len(self.items)))
            got = gram_hashes(np.frombuffer(bare if len(bare) * EDITS >= 1 else b"", np.uint8))
            hashes.append(got)
            sizes.append(len(got))
            self.bodies.append(bare)
            self.items.append(item_id)
        sizes = np.array(sizes, np.int64)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        by = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes = hashes[by]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
        self.keys, self.first = hashes[first], np.append(first, len(by)).astype(np.int32)
        ends = np.cumsum(sizes)
        self.owner = np.searchsorted(ends, by, "right").astype(np.int32)
        self.place = by - (ends - sizes)[self.owner].astype(np.int32)
        self.bloom = np.zeros(1 << _BLOOM, bool)
        self.bloom[(self.keys >> np.uint64(64 - _BLOOM)).astype(np.int64)] = True
        self.size = np.minimum(np.array([len(w) for w in self.bodies], np.int64), WINDOW)  # of an item's windows
        self.edits = np.floor(self.size * EDITS).astype(np.int64)
        self.bound = np.maximum(1, self.size + 1 - Q * (self.edits + 1))
        self.short = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)])) for k, v in short.items()}

    def _short(self, buf: np.ndarray, off: np.ndarray):
        """(document, place of the item) of items that have no q-gram."""
        words, first = _plain_words(buf, off)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        for k, (keys, items) in self.short.items():
            runs = _sequences(words, k)
            at = np.flatnonzero(np.isin(runs, keys) & (owner[: len(runs)] == owner[k - 1 :][: len(runs)]))
            lo, hi = (np.searchsorted(keys, runs[at], side) for side in ("left", "right"))
            for d, a, b in zip(owner[at].tolist(), lo.tolist(), hi.tolist(), strict=True):
                yield from ((d, int(i)) for i in items[a:b])

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """(document, place of the item in `items`) of verified regions, of normalised texts."""
        found: dict[tuple[int, int], bool] = dict.fromkeys(self._short(buf, off), True) if self.short else {}
        if not len(self.keys):
            return list(found)
        at, hashes = [], []
        for p in range(0, len(buf), STEP):
            own = gram_hashes(buf[p : p + STEP + Q - 1])
            some = np.flatnonzero(self.bloom[(own >> np.uint64(64 - _BLOOM)).astype(np.int32)])
            at.append(some + p)
            hashes.append(own[some])
        if not at:
            return list(found)
        at, hashes = np.concatenate(at), np.concatenate(hashes)
        k = np.searchsorted(self.keys, hashes)
        hit = self.keys[np.minimum(k, len(self.keys) - 1)] == hashes
        at, k = at[hit], k[hit]
        # A stretch of text at a time, if its q-grams are frequent ones; neighbouring stretches overlap by what a window spans.
        total = np.cumsum(self.first[k + 1] - self.first[k], dtype=np.int64)
        i = 0
        while i < len(at):
            j = int(np.searchsorted(total, (total[i - 1] if i else 0) + HITS, "right"))
            j = max(j, int(np.searchsorted(at, at[i] + 2 * REACH)))
            self._count(buf, off, at[i:j], k[i:j], found)
            i = int(np.searchsorted(at, at[j] - REACH)) if j < len(at) else j
        return list(found)

    def _count(self, buf: np.ndarray, off: np.ndarray, at: np.ndarray, k: np.ndarray, found: dict) -> None:
        """Adds the verified regions of q-grams `k` at places `at` of the text to `found`."""
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        n = (self.first[k + 1] - self.first[k]).astype(np.int64)
        entry = np.arange(n.sum()) + np.repeat(self.first[k] - (np.cumsum(n) - n), n)
        at, doc, item, place = np.repeat(at, n), np.repeat(doc, n), self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)
        diagonal = at - place - off[doc]
        width = self.edits[item] + 1
        for back in (0, 1):  # each hit counts in two bands of twice the width; any `width` diagonals are in one of them
            band = (diagonal + back * width) // (2 * width)
            key = mix(mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + item.astype(np.uint64)) + (band + 1).astype(np.uint64))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            some = np.flatnonzero(count[inverse] >= self.bound[item])
            some = some[np.lexsort((place[some], inverse[some]))]
            some = some[(np.diff(inverse[some], prepend=-1) != 0) | (np.diff(place[some], prepend=-1) != 0)]
            group, places, owner = inverse[some], place[some], item[some]
            # A window holds `bound` places if the one that many further on is of the same band and near.
            last = np.arange(len(some)) + self.bound[owner] - 1
            last[last >= len(some)] = -1
            full = (last >= 0) & (group[last] == group) & (places[last] - places <= self.size[owner] - Q) if len(some) else np.zeros(0, bool)
            for g in np.unique(group[full]).tolist():
                own = slice(*np.searchsorted(group, [g, g + 1]).tolist())
                head = some[own.start]
                d, w = int(doc[head]), int(item[head])
                if found.get((d, w)):
                    continue
                lo = (2 * int(band[head]) - back) * int(width[head])
                if self._meets(w, places[own], buf[off[d] : off[d + 1]], lo, lo + 2 * int(width[head])):
                    found[d, w] = True

    def _meets(self, w: int, places: np.ndarray, text: np.ndarray, lo: int, hi: int) -> bool:
        """Is some window of item `w`, where `places` (sorted, distinct) are shared, within its edits of `text` between diagonals lo and hi?"""
        size, edits, bound = int(self.size[w]), int(self.edits[w]), int(self.bound[w])
        # Windows that hold at least `bound` of the places: those from ends[i] - grams + 1 to places[i] for a run of `bound`.
        grams = size - Q + 1
        first, last = places[: len(places) - bound + 1], places[bound - 1 :]
        near = last - first < grams
        end = len(self.bodies[w]) - size
        begin, stop = np.maximum(last[near] - grams + 1, 0), np.minimum(first[near], end)
        starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]))
        if not len(starts):
            return False
        held = np.searchsorted(places, starts + grams) - np.searchsorted(places, starts)
        starts = starts[np.argsort(-held, kind="stable")]  # the likeliest first
        s = int(starts[0])
        if self.bodies[w][s : s + size] in text[max(0, s + lo - edits) : max(0, s + hi + size + edits)].tobytes():
            return True
        body = np.frombuffer(self.bodies[w], np.uint8).astype(np.int16)
        span = hi - lo + size + 2 * edits
        step, begin = 8, 0
        while begin < len(starts):
            own = starts[begin : begin + step]
            windows = body[own[:, None] + np.arange(size)]
            at = (own + lo - edits)[:, None] + np.arange(span)
            regions = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], np.int16(-1))  # -1 equals no byte
            if any_within(windows, regions, edits):
                return True
            begin, step = begin + step, BATCH
        return False


def within(window: bytes, region: bytes, edits: int) -> bool:
    """Is some stretch of `region` within `edits` edits of the whole `window`? Rows of the window against the band."""
    if window in region:
        return True
    if len(region) < len(window) - edits:
        return False
    text = np.frombuffer(region, np.uint8)
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # a stretch may begin anywhere
    for i, c in enumerate(window):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (text != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
        if row.min() > edits:
            return False
    return bool(row.min() <= edits)


def any_within(windows: np.ndarray, regions: np.ndarray, edits: int) -> bool:
    """Is some row of `windows` within `edits` edits of a stretch of its row of `regions`? As `within`, many at a time."""
    step = np.arange(regions.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(windows), regions.shape[1] + 1), np.int16)
    for i in range(windows.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (regions != windows[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        new -= step
        row = np.minimum.accumulate(new, axis=1, out=new)
        row += step
        alive = row.min(axis=1) <= edits
        if not alive.all():
            if not alive.any():
                return False
            row, windows, regions = row[alive], windows[alive], regions[alive]
    return True


def _run(index: Index):
    """Adds a block's items to those found so far."""

    def run(parts):
        for part in parts:
            buf, off = buffer_of(part.column("text"))
            lists, dirty = part.column("item_ids").to_pylist(), np.array(part.column("contaminated").to_numpy(zero_copy_only=False), bool)
            for i, j in slices(off, STEP):
                own, at = normalised(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for d, w in index.search(own, at):
                    dirty[i + d] = True
                    item = index.items[w]
                    if item is not None:
                        lists[i + d].append(item)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array([sorted(set(x)) for x in lists], pa.list_(pa.int64())), pa.array(dirty)],
                ["doc_id", "text", "item_ids", "contaminated"],
            )

    return run


def indexes(benchmark: DataFrame):
    """One index after the other, each of about BLOCK_BYTES of item text (an item that is longer is taken whole)."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # BLOCK_BYTES on average
        yield Index([(r["item_id"], bytes(r["text"])) for r in own])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_items, item_ids (sorted) and contaminated."""
    batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.array().cast("array<long>").alias("item_ids"), F.lit(False).alias("contaminated"))
    for index in indexes(benchmark):
        out = out.mapInArrow(frugal(_run(index)), out.schema)
    return out.select("doc_id", F.size("item_ids").alias("n_items"), "item_ids", "contaminated")


def _drop(index: Index):
    def run(parts):
        for part in parts:
            texts = part.column("text").cast(pa.binary()).fill_null(b"")
            buf, off = buffer_of(texts)
            clean = np.ones(part.num_rows, bool)
            for i, j in slices(off, STEP):
                own, at = normalised(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                for d, _ in index.search(own, at):
                    clean[i + d] = False
            yield part.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, whose text holds no benchmark window."""
    batches(docs.sparkSession)
    for index in indexes(benchmark):
        docs = docs.mapInArrow(frugal(_drop(index)), docs.schema)
    return docs


common.ship(__name__)
