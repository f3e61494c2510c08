"""Names in texts: which aliases occur in a text as a run of whole words.

The aliases are a trie over words, of which only hashes are kept: one bitmap has every alias's beginnings, one has the whole
aliases. All places of a batch of texts go down the trie together, a word at a time: a place goes on while what it has read is
the beginning of an alias, and is a candidate where it is a whole one. Few places have a second word to read. Candidates' words are
then joined with the aliases themselves, so a hash that is there by chance gives no row.

Scale. Texts are read once, without a row per word. The bitmaps are made by an aggregate, and have 16 bits for each
word of the aliases but MOST_BITS bits at most, so any number of aliases can be looked for: the join after them is broadcast only
if the aliases are checked to be few. Long texts are read in steps of STEP bytes, which overlap by the longest alias.

Words are lower-case runs of letters and digits. A null or wordless text has no names, a wordless alias none; repeated aliases give one row a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import small

STEP = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
_FACTOR = 0x9E3779B97F4A7C15
_SPACE = 0x20


def plain(text: str) -> Column:
    """Words with one blank between them and one at the end."""
    return F.concat(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of `buf`, which end with a blank each."""
    ends = np.flatnonzero(buf == _SPACE)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf)))) if starts[0] == 0 else None
    if place is None:  # blanks before the first word
        at, s, e, h = int(starts[0]), *words(buf[int(starts[0]) :])
        return s + at, e + at, h
    power = np.full(int(size.max()) + 2, _FACTOR | 1, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = (buf.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)]
    value[buf == _SPACE] = 0
    return starts, ends, _mixed(np.add.reduceat(value, starts) + size.astype(np.uint64))


def onward(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run of words and one word more."""
    return _mixed(state * np.uint64(_FACTOR | 1) + word)


class Bits:
    """A set of hashes as a bitmap; has some others too."""

    def __init__(self, size: int):
        self.size, self.longs = size, np.zeros(size // 64, np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        bit = h % np.uint64(self.size)
        return (self.longs[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _bits_of(size: int):
    """A worker's function: (whole, place, mask) of the bits that aliases (name as bytes) set."""

    def run(batches):
        for batch in batches:
            found: dict[tuple[bool, int], int] = {}
            for name in batch.column("name").to_pylist():
                state = np.zeros(1, np.uint64)
                own = words(np.frombuffer(name, np.uint8))[2]
                for i, h in enumerate(own):
                    state = onward(state, h[None])
                    bit = int(state[0] % np.uint64(size))
                    at = (i + 1 == len(own), bit >> 6)
                    found[at] = found.get(at, 0) | 1 << (bit & 63)
            masks = np.array(list(found.values()), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.bool_()), pa.array([p for _, p in found], pa.int64()), pa.array(masks)], ["whole", "place", "mask"])

    return run


def steps(data: np.ndarray, longest: int):
    """(start, end) of pieces of about STEP bytes that end with a blank and overlap by `longest` - 1 words."""
    blanks = np.flatnonzero(data == _SPACE)
    first = 0
    while True:
        at = int(blanks[first - 1]) + 1 if first else 0
        last = max(int(np.searchsorted(blanks, at + STEP)), first + longest)
        if last >= len(blanks):
            yield at, len(data)
            return
        yield at, int(blanks[last]) + 1
        first = last + 2 - longest


def runs(buf: np.ndarray, offsets: np.ndarray, begin: Bits, whole: Bits, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, hash) of the runs of words that may be aliases; no run lies in two texts."""
    starts, ends, h = words(buf)
    text = np.searchsorted(offsets, starts, "right") - 1
    place, state, out = np.arange(len(h)), np.zeros(len(h), np.uint64), []
    for n in range(longest):
        last = place + n
        on = last < len(h)
        place, state, last = place[on], state[on], last[on]
        on = text[last] == text[place]
        place, last = place[on], last[on]
        state = onward(state[on], h[last])
        hit = whole.has(state)
        out.append((text[place[hit]], starts[place[hit]], ends[last[hit]], state[hit]))
        on = begin.has(state)
        place, state = place[on], state[on]
        if not len(place):
            break
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _candidates(begin: Bits, whole: Bits, longest: int):
    """A worker's function: (path, name) of texts (path, content as `plain` bytes), each name once a text and step."""

    def run(batches):
        for batch in batches:
            data = batch.column("content")
            off = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            buf = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
            i = 0
            while i < len(data):
                j = max(i + 1, int(np.searchsorted(off, off[i] + STEP, "right")) - 1)
                own = buf[off[i] : off[j]]
                pieces = steps(own, longest) if j == i + 1 else [(0, len(own))]
                for a, b in pieces:
                    text, start, end, h = runs(own[a:b], off[i : j + 1] - off[i] if j > i + 1 else np.array([0, b - a]), begin, whole, longest)
                    if len(text):
                        _, first = np.unique(np.stack([text.astype(np.uint64), h], 1), axis=0, return_index=True)
                        names = [bytes(own[a + start[x] : a + end[x]]).decode() for x in first]
                        yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(text[first] + i)), pa.array(names, pa.string())], ["path", "name"])
                i = j

    return run


def mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, id) of the pages whose alias occurs in a text as a run of whole words; texts: path, content; aliases: id, alias."""
    known = aliases.select("id", F.trim(plain("alias")).alias("name")).where("name <> ''").distinct()
    figures = known.agg(F.sum(F.size(F.split("name", " ")).cast("long")).alias("words"), F.max(F.size(F.split("name", " "))).alias("longest")).first()
    if not figures["words"]:
        return texts.select("path").join(known.select("id"), F.lit(False))
    size = min(max(LEAST_BITS, 1 << (16 * figures["words"] - 1).bit_length()), MOST_BITS)
    set_ = known.select(F.concat("name", F.lit(" ")).cast("binary").alias("name")).mapInArrow(_bits_of(size), "whole boolean, place long, mask long")
    begin, whole = Bits(size), Bits(size)
    longs = set_.groupBy("whole", "place").agg(F.bit_or("mask").alias("mask")).toArrow()  # MOST_BITS / 64 rows of each at most
    for bits, is_whole in ((begin, False), (whole, True)):
        own = longs.filter(pc.equal(longs["whole"], is_whole))
        bits.longs[np.asarray(own["place"])] = np.asarray(own["mask"]).astype(np.int64).view(np.uint64)
    path = dict(texts.dtypes)["path"]
    rows = texts.where("content is not null").select("path", plain("content").cast("binary").alias("content"))
    found = rows.mapInArrow(_candidates(begin, whole, figures["longest"]), f"path {path}, name string")
    return found.join(small(known), "name").select("path", "id").distinct()
