"""Quality scores by histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features, with the logistic loss's gradients and curvatures
summed into histograms, and flattened into arrays (feature, threshold, children, value) that numpy
walks for a whole batch at once.

Scale. Statistics and scores are per row, without a shuffle. The trees are fitted on the driver from
statistics (not texts) of at most `max_rows` labelled training rows, those with the smallest hash of
their doc_id, which are broadcast to find them, and are a few hundred kB however large the input is.

Defined cases: a null or empty text has all counts 0 and is scored like any; different labels of one
doc_id are a training row each, equal ones and repeated rows one (of different texts the least counts); labels whose doc_id is missing, null or not in `docs` are
not used; with no training rows, or one class only, every score is the smoothed share of label 1.
Neither labels, lang, source nor doc_id enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import remainder, stash
from quillstone.llm.docstats import NAMES, with_statistics


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of features from statistics: sizes on a log scale and shares per word, line or character."""
    x = {k: np.asarray(v, float) for k, v in x.items()}
    words, chars, lines = (np.maximum(x[k], 1) for k in ("n_words", "n_chars_all", "n_ink_lines"))
    per_word = ("word_chars", "n_symbols", "n_repeat_words", "n_distinct_words", "n_same_next", "n_stops", "n_bangs", "n_bare_words", "n_caps_words", "n_digits")
    shares = [x[k] / words for k in per_word] + [x[k] / chars for k in ("n_lower", "n_upper", "n_digits", "n_wide", "n_symbols")] + [x["n_dup_lines"] / lines, words / lines]
    return np.stack([np.log1p(x["n_words"]), np.log1p(x["n_lines"]), *shares], axis=1)


class Trees:
    """Boosted trees with logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.feature = self.threshold = self.value = None
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n = len(y)
        share = (y.sum() + 1) / (n + 2)
        self.start = float(np.log(share / (1 - share)))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((0, size), np.int32)
        self.threshold, self.value = np.zeros((0, size)), np.zeros((0, size))
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(n, self.start)
        made = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            made.append(self._grow(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6)))
            feature, threshold, value = made[-1]
            raw += self._walk(x, feature[None], threshold[None], value[None])
        self.feature, self.threshold, self.value = (np.stack(z) for z in zip(*made, strict=True))
        return self

    def _grow(self, binned, cuts, g, h):
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth + 1):
            lo, width = 2**level - 1, 2**level
            here = node - lo
            live = here >= 0
            G, H = (np.bincount(here[live], w[live], width) for w in (g, h))
            value[lo : lo + width] = -self.rate * G / (H + self.ridge)
            if level == self.depth:
                break
            best, gain = np.full((width, 2), -1), np.full(width, 1e-6)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key = here[live] * (len(cut) + 1) + binned[live, f]
                GL, HL = (np.cumsum(np.bincount(key, w[live], width * (len(cut) + 1)).reshape(width, -1), axis=1)[:, :-1] for w in (g, h))
                HR = H[:, None] - HL
                gains = GL**2 / (HL + self.ridge) + (G[:, None] - GL) ** 2 / (HR + self.ridge) - (G**2 / (H + self.ridge))[:, None]
                gains[(HL < self.least * 0.1) | (HR < self.least * 0.1)] = -1
                at = gains.argmax(1)
                top = gains[np.arange(width), at]
                better = top > gain
                best[better], gain[better] = np.stack([np.full(width, f), at], axis=1)[better], top[better]
            split = best[:, 0] >= 0
            for k in np.flatnonzero(split):
                feature[lo + k], threshold[lo + k] = best[k, 0], cuts[best[k, 0]][best[k, 1]]
            rows = np.flatnonzero(live)
            rows = rows[split[here[rows]]]
            k = here[rows]
            right = binned[rows, best[k, 0]] > best[k, 1]
            node[rows] = 2 * (lo + k) + 1 + right
            node[np.flatnonzero(live)[~split[here[live]]]] = -1
        return feature, threshold, value

    def _walk(self, x, feature, threshold, value):
        rows, out = np.arange(len(x)), np.zeros(len(x))
        for t in range(len(feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[t, at]
                down = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > threshold[t, at])
                at = np.where(f >= 0, down, at)
            out += value[t, at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.start + self._walk(x, self.feature, self.threshold, self.value), -500, 500)))


def _scored(model: Trees):
    def run(parts):
        for part in parts:
            p = model.predict(features({n: np.asarray(part.column(n)) for n in NAMES})) if part.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, max_rows: int = 30_000) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted. Rows of fold 1 of 3 are not learned from."""
    stats = stash(with_statistics(docs).withColumn("held_out", remainder("doc_id", 3) == 1), "quality")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null").where(remainder("doc_id", 3) != 1)
    pick = F.broadcast(own.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows))  # max_rows at most
    found = stats.join(pick, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*NAMES)).alias("s"))
    train = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y").select("y", "s.*").toArrow()
    x = features({n: np.asarray(train[n]) for n in NAMES}) if len(train) else np.zeros((0, 19))
    model = Trees().fit(x, np.asarray(train["y"]).astype(float))
    out = stats.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


common.ship(__name__)
