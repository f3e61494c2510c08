"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (its documents one after the other, each with a closing id). Window
by window, each queue earns its share of the window's tokens and is served what it has earned in whole runs of
RUN tokens, so that sources, however many, don't cut documents to crumbs; what is
left of a run is a deficit that it carries into the next window. By default the shares are the
queues' own sizes, so that every window has the mixture of the whole input and all queues run dry
together; with `targets`, a queue that runs dry leaves its share to the others. What is left of a queue after its
whole runs, less than one, comes at the end, queue after queue.

With whole runs, a queue's service until a window's end has a closed form: the queues' shares lie on a line, and
the runs so far are halved down that line (`dealt`), so where any document is cut follows from its place in
its queue alone. No task has to see the windows before its own, deficits pass windows and partitions
by arithmetic, and only the last window can be short.

Words are looked up by a 64-bit hash: two of a worker's two million remembered words share one with a
probability of 1e-7, and would then share their ids.

Scale. Tokenised rows are written once (two bytes an id) with their place in their partition's part of
the queue; the parts' sizes, one row per partition and source, give each part's place in its queue.
The queues' totals and their running sum are a table too, so any number of sources is as exact as one.
The driver holds the totals of the queues that have a target (and a schedule of the phases between their ends, which
grows with the square of the number of targets), and one sum for each range of queues.

Defined cases: a null text is empty, and an empty document is its closing id alone; a null source is a
queue like any other; repeated rows are each packed; an empty table gives no rows; a document longer
than a window is cut over as many as it needs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import _LOWER, batches, buffer_of, frugal, slices, stash, text_bytes, word_hashes, word_spans

LENGTH = 4096
RUN = 128  # tokens; a divisor of LENGTH
CLOSING = 2
MEMO = 2_000_000  # words whose ids a worker remembers, in arrays of some 20 bytes a word
SLICE = 2 << 20  # bytes of text at a time; every slice passes over the remembered words
#: Rows of (partition, source) that are broadcast at most; above, tokens and places are joined by a shuffle.
SMALL_PARTS = 200_000
_MARK = b"\x01"  # stands alone between words that are tokenised together
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def tokenizer_path() -> str:
    """The public vocabulary file that is the default; a caller can name another."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of words by their 64-bit hashes, from a tokenizer that splits at white space and lower-cases.

    Such a tokenizer's ids of a text are the ids of its words one after the other. It also splits between
    a letter and a full stop or the like, so these are looked up apart, and words by their lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        encode = lambda texts: [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if len(self.mark) != 1 or any(_MARK in w for w in words):
            return encode(words)
        out: list[np.ndarray] = []
        for ids in encode([(b" " + _MARK + b" ").join(words[i : i + 500]) for i in range(0, len(words), 500)]):
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            begin = 0
            for end in ends:
                out.append(ids[begin:end])
                begin = end + 1
        assert len(out) == len(words)
        return out

    def places(self, keys: np.ndarray, spell) -> np.ndarray:
        """Where distinct sorted `keys` are in the table, after adding those it lacks; spell(places in keys) gives words."""
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            if len(self.keys) + len(fresh) > MEMO and len(self.keys):
                self.clear()
                return self.places(keys, spell)
            ids = self._encode(spell(fresh))
            size = np.array([len(x) for x in ids], np.int64)
            start = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, *ids])
            self.keys, self.start, self.size = (np.insert(a, at[fresh], b) for a, b in ((self.keys, keys[fresh]), (self.start, start), (self.size, size)))
            at = np.searchsorted(self.keys, keys)
        return at

    def ids(self, buf: np.ndarray, off: np.ndarray, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, each with `closing` after it; their offsets)."""
        low = _LOWER[buf]
        starts, ends, first = word_spans(low, off)
        letter = (low >= 97) & (low <= 122)
        cut = np.flatnonzero(_STOP[low[1:]] & letter[:-1]) + 1
        cut = cut[~np.isin(cut, off)]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        first = np.searchsorted(starts, off)
        if len(starts):
            keys, index, inverse = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
            raw = low.tobytes()
            at = self.places(keys, lambda some: [raw[a:b] for a, b in zip(starts[index[some]].tolist(), ends[index[some]].tolist(), strict=True)])
            begin, size = self.start[at][inverse], self.size[at][inverse]
        else:
            begin = size = np.zeros(0, np.int64)
        # Ids of the words, with a place left for the closing id after each document.
        total = np.concatenate([[0], np.cumsum(size)])
        offsets = total[first] + np.arange(len(off))
        pick = np.repeat((begin - total[:-1]).astype(np.int32), size) + np.arange(total[-1], dtype=np.int32)
        out = np.empty(total[-1] + len(off) - 1, np.uint16)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = self.flat[pick]
        out[~body] = closing
        return out, offsets


def _words(path: str) -> Words:
    """The worker's own table for a vocabulary file; it outlives a task where Spark keeps the worker."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_quillstone_words", {})
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def _tokenise(path: str, closing: int):
    def run(parts):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words, place, part_id = _words(path), {}, TaskContext.get().partitionId()
        for part in parts:
            buf, off = buffer_of(part.column("text"))
            queues = part.column("queue").to_pylist()
            for i, j in slices(off, SLICE):
                ids, at = words.ids(buf[off[i] : off[j]], off[i : j + 1] - off[i], closing)
                counts, offs = np.diff(at), []
                for queue, n in zip(queues[i:j], counts.tolist(), strict=True):
                    offs.append(place.get(queue, 0))
                    place[queue] = offs[-1] + n
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * at).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id")[i:j], part.column("queue")[i:j], pa.array(np.full(j - i, part_id, np.int64)), pa.array(offs, pa.int64()), pa.array(counts), raw],
                    ["doc_id", "queue", "part", "at", "doc_tokens", "ids"],
                )

    return run


def dealt(x: int, runs: int, whole: int) -> int:
    """How many of the first `runs` runs go to the first `x` units of a line of `whole` units of share.

    Half of the line, by its length, is dealt half of the runs, rounded, and so on inwards. So each unit's count
    never falls as runs go on, all add up to `runs`, and any stretch of the line is a few runs off its share at most.
    """
    lo, hi, out = 0, whole, 0
    while runs and x > lo:
        if x == hi:
            return out + runs
        mid = (lo + hi) // 2
        left = (2 * runs * (mid - lo) + hi - lo) // (2 * (hi - lo))
        if x <= mid:
            hi, runs = mid, left
        else:
            lo, runs, out = mid, runs - left, out + left
    return out


class Schedule:
    """Who is served when: phases in which the same queues are served, in fixed order, by whole-number shares.

    All in runs: `totals` of the queues, and positions.
    """

    def __init__(self, totals: dict, weights: dict | None = None):
        left = {q: totals[q] for q in sorted(totals, key=lambda q: (q is not None, q)) if totals[q]}
        self.phases = []  # (first position, end, {queue: (its first run, sum of shares before, its share)}, sum of all)
        done, at = dict.fromkeys(left, 0), 0
        while left:
            share = {q: weights.get(q, 0) if weights else totals[q] for q in left}
            if not any(share.values()):
                share = dict.fromkeys(left, 1)
            before, whole = {}, 0
            for q, s in share.items():
                before[q] = whole
                whole += s
            owed = lambda q, p: dealt(before[q] + share[q], p, whole) - dealt(before[q], p, whole)  # noqa: B023, E731
            # The phase ends where the first queue runs dry. What a queue is owed is a run for each halving off its exact share
            # at most, so that place is between these two, and only queues that are near their end there need a look.
            off = 2 * whole.bit_length()
            sure = {q: (left[q] - off) * whole // s for q, s in share.items() if s}
            lo, hi = max(1, min(sure.values())), max(1, min((left[q] + off) * whole // share[q] + 1 for q in sure))
            near = [q for q, p in sure.items() if p <= hi]
            hi = min(hi, sum(left.values()))
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if all(owed(q, mid) <= left[q] for q in near) else (lo, mid - 1)
            self.phases.append((at, at + lo, {q: (done[q], before[q], s) for q, s in share.items()}, whole))
            for q, n in {q: owed(q, lo) for q in share}.items():
                done[q] += n
                left[q] -= n
            left = {q: n for q, n in left.items() if n}
            at += lo
        self.size = at

    def phases_of(self, queue) -> list:
        return [(at, end, *table[queue], whole) for at, end, table, whole in self.phases if queue in table]

    def pieces(self, queue, first: int, size: int, length: int = LENGTH // RUN):
        """(window, offset there, runs) of `size` runs of a queue from its run `first` on."""
        return serve(self.phases_of(queue), first, size, length)


def serve(phases, first: int, size: int, length: int = LENGTH // RUN, deal=dealt):
    """`Schedule.pieces` by a queue's own phases: (first position, end, its first run, sum of shares before, its share, sum of all)."""
    phases = iter(phases)
    while size:
        at, end, done, before, share, whole = next(phases)
        ahead = lambda p: deal(before, p, whole)  # noqa: B023, E731
        served = lambda p: done + deal(before + share, p, whole) - ahead(p)  # noqa: B023, E731
        if served(end - at) <= first:
            continue
        # The window where run `first` is served: about first / share, then exactly.
        w = (at + ((first - done) * whole // share if share else 0)) // length
        stop = lambda w: min((w + 1) * length, end) - at  # noqa: B023, E731
        while w * length > at and served(w * length - at) > first:
            w -= 1
        while served(stop(w)) <= first:
            w += 1
        begin = max(w * length, at) - at
        lo, skipped = served(begin), ahead(begin)
        while size and w * length < end:
            hi, passed = served(stop(w)), ahead(stop(w))
            n = min(size, hi - first)
            if n > 0:
                # Before this queue's runs come those of the queues before it, and the window's earlier phase.
                yield w, begin + at - w * length + passed - skipped + first - lo, n
                first += n
                size -= n
            w, begin, lo, skipped = w + 1, (w + 1) * length - at, hi, passed


def token_pieces(phases, first: int, size: int, total: int, rest_at: int, deal=dealt):
    """(window, offset there, tokens) of `size` tokens from token `first` on of a queue of `total` tokens whose last, broken run is at `rest_at`."""
    full, end = total // RUN * RUN, first + size
    if first < full:
        run = first // RUN
        for w, offset, n in serve(phases, run, -(-min(end, full) // RUN) - run, deal=deal):
            lo = max(first, run * RUN)
            run += n
            yield w, offset * RUN + lo - (run - n) * RUN, min(end, run * RUN) - lo
    at, left = rest_at + max(first - full, 0), end - max(first, full)
    while left > 0:
        w, offset = divmod(at, LENGTH)
        n = min(left, LENGTH - offset)
        yield w, offset, n
        at, left = at + n, left - n


def _cut(phases: dict, begin: int, whole: int):
    """Cuts by the phases of the queues with a target; the others are one phase of `whole` runs from run `begin` on."""

    def run(parts):
        from functools import lru_cache

        deal = lru_cache(1 << 16)(dealt)  # a queue's documents follow each other in the same windows
        for part in parts:
            rows = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            columns = [part.column(c).to_pylist() for c in ("doc_id", "queue", "first", "doc_tokens", "ids", "before", "total", "rest_at")]
            for doc_id, queue, first, size, raw, before, total, rest_at in zip(*columns, strict=True):
                wide = np.frombuffer(raw, np.uint16).astype("<u4").tobytes()
                start = 0
                own = phases[queue] if before is None else [(begin, begin + whole, 0, before, total // RUN, whole)]
                for window, offset, n in token_pieces(own, first, size, total, rest_at, deal):
                    crc = zlib.crc32(wide[4 * start : 4 * (start + n)])
                    for c, v in zip(rows, (doc_id, start, n, crc, size, window, offset), strict=True):
                        rows[c].append(v)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))

    return run


def pack(docs: DataFrame, path: str | None = None, closing: int = CLOSING, targets: dict[str, int] | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: whole-number shares by source; by default every source's share of the input. Sources without
    a target come after those with one, by their shares of what is left of the input. path: a vocabulary of at
    most 65,536 ids.
    """
    spark = docs.sparkSession
    batches(spark)
    path = path or tokenizer_path()
    if Words(path).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError(f"{path} has more ids than two bytes can tell apart")
    queue = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), text_bytes().alias("text"))
    tokens = stash(rows.mapInArrow(frugal(_tokenise(path, closing)), "doc_id long, queue string, part long, at long, doc_tokens long, ids binary"), "tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    parts = stash(parts.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")), "parts")
    named = {q: w for q, w in (targets or {}).items() if w}
    aimed = F.coalesce(F.col("queue").isin(*named), F.lit(False)) if named else F.lit(False)
    totals = {r["queue"]: int(r["n"]) for r in parts.where(aimed).groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one a target
    schedule = Schedule({q: n // RUN for q, n in totals.items()}, named)
    others = parts.where(~aimed).groupBy("queue").agg(F.sum("n").alias("total"))
    runs, rest = F.floor(F.col("total") / RUN).alias("runs"), (F.col("total") % RUN).alias("rest")
    others = stash(others.select("queue", "total", runs, rest).orderBy("queue").withColumn("range", F.spark_partition_id()), "queues")
    sums, whole, broken = [], 0, sum(n % RUN for n in totals.values())
    for r in others.groupBy("range").agg(F.sum("runs").alias("runs"), F.sum("rest").alias("rest")).orderBy("range").collect():  # one a partition
        sums.append((r["range"], whole, broken))
        whole, broken = whole + int(r["runs"]), broken + int(r["rest"])
    tails = RUN * (schedule.size + whole)  # where the broken runs begin: those of targets, then the others'
    sums = spark.createDataFrame(sums, "range int, ahead long, broken long")
    running = lambda c: F.sum(c).over(Window.partitionBy("range").orderBy("queue")) - F.col(c)
    others = others.join(F.broadcast(sums), "range").select(F.col("queue").alias("o"), (F.col("ahead") + running("runs")).alias("before"), "total", (F.lit(tails) + F.col("broken") + running("rest")).alias("rest_at"))
    at, fixed = tails, []
    for q, n in totals.items():
        fixed.append((q, None, n, at))
        at += n % RUN
    queues = others.union(spark.createDataFrame(fixed, "o string, before long, total long, rest_at long"))
    small = parts.count() <= SMALL_PARTS
    parts = parts.join(queues, F.col("queue").eqNullSafe(F.col("o"))).select(F.col("queue").alias("q"), F.col("part").alias("p"), "base", "before", "total", "rest_at")
    placed = tokens.join(F.broadcast(parts) if small else parts, (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("q")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("first"), "doc_tokens", "ids", "before", "total", "rest_at")
    return placed.mapInArrow(_cut({q: schedule.phases_of(q) for q in totals}, schedule.size, whole), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


common.ship(__name__)
