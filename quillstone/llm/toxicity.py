"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with word borders), hashed into one
table; a window of words is the mean of its words' vectors; a linear
softmax over two classes scores the window, and a document has the mean of its windows' scores weighted
by their softmax, which is close to the highest, so that one insult in a long text isn't averaged away.
The table and the softmax are trained jointly in numpy by gradient descent. A misspelling that was
never seen shares most n-grams, hence most of its vector, with the word it comes from.

Scale. Scoring is one pass over the rows, without a shuffle; the model is BUCKETS x DIM floats whatever
the input. It is fitted on the driver from the whole texts of at most `max_rows` labelled training
rows, all of label 1 first up to half of them, taken by the smallest hash of doc_id, as long as they have
`max_bytes` together: a row whose text would go beyond is passed over. A document longer than SLICE_BYTES is
scored in steps of as many words as half of that.

Defined cases: null, empty and wordless texts have the score of an empty window; different labels of one
doc_id are a training row each, equal ones and repeated rows one (of different texts the least); with no training rows, or one class only, every score is the
smoothed share of label 1; neither labels, lang, source nor doc_id enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import _LOWER, SLICE_BYTES, batches, buffer_of, frugal, mix, remainder, slices, stash, text_bytes, unstash, word_hashes, word_spans

BUCKETS, DIM = 1 << 16, 16
GRAM_SIZES = (3, 4, 5)
WINDOW = 2
ROUNDS, DECAY, EPSILON = 60, 1e-4, 1e-5
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, each word's place among them, first word per document), A-Z lower-cased.

    A document without words has one, the empty word.
    """
    low = _LOWER[buf]
    starts, ends, first = word_spans(low, off)
    _, index, inverse = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    raw = low.tobytes()
    words = [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
    bare = np.flatnonzero(np.diff(first) == 0)
    if len(bare):
        inverse = np.insert(inverse, first[bare], len(words))
        first = first + np.concatenate([[0], np.cumsum(np.diff(first) == 0)])
        words.append(b"")
    return words, inverse.astype(np.int32), first


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(table row, word) of the n-grams of code points of words without outer punctuation, with borders."""
    text = b" ".join(b"<" + w.strip(_EDGES) + b">" for w in words).decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == 0x20).astype(np.int32)
    rows, owners = [], []
    for n in GRAM_SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        inside = np.flatnonzero(word[:m] == word[n - 1 :])
        inside = inside[code[inside] != 0x20]
        value = np.full(len(inside), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + code[inside + k]
        rows.append((mix(value) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(word[inside])
    return (np.concatenate(rows), np.concatenate(owners)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length) of each window, and each document's first window."""
    sizes = np.diff(first)
    place = np.arange(n, dtype=np.int64) - np.repeat(first[:-1], sizes)
    heads = np.flatnonzero(place % WINDOW == 0)
    return heads, np.diff(heads, append=n), np.searchsorted(heads, first[:-1])


def _pooled(logit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each document's logit, its windows' shares in it): a mean weighted by softmax, close to the maximum."""
    owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(logit)))
    part = np.exp(logit - np.maximum.reduceat(logit, starts)[owner])
    part /= np.add.reduceat(part, starts)[owner]
    return np.add.reduceat(part * logit, starts), part


class Model:
    """start, if there is nothing to learn from; otherwise `weight`: per table row, its logit as a word."""

    def __init__(self, start: float):
        self.bias, self.weight = start, np.zeros(BUCKETS, np.float32)

    def fit(self, texts: list[bytes], y: np.ndarray, rounds: int | None = None, rate: float = 0.03, seed: int = 1) -> Model:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        vocab, stream, first = words_of(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        flat, owner = grams_of(vocab)
        sizes = np.maximum(np.bincount(owner, minlength=len(vocab)), 1).astype(np.float32)
        heads, span, begin = _windows(first, len(stream))
        span = span.astype(np.float32)
        window = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(heads, append=len(stream)))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begin, append=len(heads)))
        share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        bias = np.array([0, -2], np.float32)
        adam = [[np.zeros_like(z), np.zeros_like(z)] for z in (table, softmax, bias)]
        for step in range(1, (rounds or ROUNDS) + 1):
            # Each word's logit difference, then each window's mean, then a soft maximum over a document's windows.
            direction = softmax[:, 1] - softmax[:, 0]
            word = (np.bincount(owner, (table @ direction)[flat], len(vocab)) / sizes).astype(np.float32)
            whole, part = _pooled(np.add.reduceat(word[stream], heads) / span, begin)
            p = 1 / (1 + np.exp(-np.clip(whole + bias[1] - bias[0], -50, 50)))
            error = (p - y) * share
            # Back to the words of the windows that counted, their table rows, and the softmax.
            pull = (error[doc] * part / span).astype(np.float32)
            words = np.bincount(stream, pull[window], len(vocab)) / sizes
            rows = np.bincount(flat, words[owner], BUCKETS).astype(np.float32)
            s = rows @ table + DECAY * direction
            b = error.sum()
            grads = (rows[:, None] * direction + DECAY / 100 * table, np.stack([-s, s], 1), np.array([-b, b], np.float32))
            for z, g, (m, v) in zip((table, softmax, bias), grads, adam, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                z -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)
        self.weight = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        return self

    def words(self, words: list[bytes]) -> np.ndarray:
        """Each word's logit difference."""
        rows, owner = grams_of(words)
        return np.bincount(owner, self.weight[rows], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of label 1 per document."""
        if len(off) == 2 and len(buf) > 2 * SLICE_BYTES:
            logit = self._long(buf)
            begin = np.zeros(1, np.int64)
        else:
            words, place, first = words_of(buf, off)
            heads, span, begin = _windows(first, len(place))
            logit = np.add.reduceat(self.words(words)[place], heads) / span
        whole, _ = _pooled(logit, begin)
        return 1 / (1 + np.exp(-np.clip(whole + self.bias, -50, 50)))

    def _long(self, buf: np.ndarray) -> np.ndarray:
        """The windows' logits of one document, a whole number of windows' words at a time."""
        starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
        out, step = [], SLICE_BYTES // 16 * WINDOW
        for i in range(0, max(len(starts), 1), step):
            a, b = (starts[i], ends[min(i + step, len(ends)) - 1]) if len(starts) else (0, 0)
            words, place, first = words_of(buf[a:b], np.array([0, b - a]))
            heads, span, _ = _windows(first, len(place))
            out.append(np.add.reduceat(self.words(words)[place], heads) / span)
        return np.concatenate(out)


def _scores(model: Model, parts):
    """(scores, batch) of batches with a column text."""
    for part in parts:
        buf, off = buffer_of(part.column("text").cast(pa.binary()).fill_null(b""))
        got = [model.score(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
        yield np.concatenate(got) if got else np.zeros(0), part


def _score(model: Model):
    def run(parts):
        for out, part in _scores(model, parts):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(out)], ["doc_id", "held_out", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 2_000, max_bytes: int = 8 << 20) -> Model:
    """The model of the training rows (fold not 1 of 3) of `docs`; see the module for what it takes."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(remainder("doc_id", 3) != 1).distinct()
    shares = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones = min(shares.get(1, 0), max_rows // 2)
    first = lambda y, n: own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    pick = F.broadcast(first(1, ones).union(first(0, max_rows - ones)))  # max_rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(pick, "doc_id")
    found = stash(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "training")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"))
    sizes = found.select("doc_id", "y", F.octet_length("text").alias("n")).orderBy(*order).collect()  # max_rows at most
    left, chosen = max_bytes, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["doc_id"], r["y"]))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, y int"))
    rows = found.join(chosen, ["doc_id", "y"]).orderBy(*order).select("y", "text").toArrow()  # max_bytes at most
    unstash(found)
    y = np.asarray(rows["y"]).astype(float)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return Model(start)
    return Model(start).fit(rows["text"].to_pylist(), y)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, max_rows: int = 2_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted."""
    batches(docs.sparkSession)
    model = train(docs, labels, label, max_rows, max_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 3) == 1).alias("held_out"), text_bytes().alias("text"))
    out = rows.mapInArrow(frugal(_score(model)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep(model: Model, threshold: float):
    def run(parts):
        for scored, part in _scores(model, parts):
            yield part.filter(pa.array(scored < threshold))

    return run


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, max_rows: int = 2_000, max_bytes: int = 8 << 20) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold`."""
    batches(docs.sparkSession)
    return docs.mapInArrow(frugal(_keep(train(docs, labels, label, max_rows, max_bytes), threshold)), docs.schema)


common.ship(__name__)
