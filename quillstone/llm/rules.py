"""Quality rules under weak supervision.

Each rule looks at a document's statistics and votes good (1), bad (0) or abstains (null). Instead of
dropping what any one rule dislikes, expectation-maximisation estimates how far each rule can be
trusted - the probability of each of its votes given a good or a bad document - from the rules'
agreement and a weak prior belief in rules, and a document's posterior probability of being good decides.

Scale. Votes are JVM expressions over one row; the model sees only the counts of vote patterns, at
most 3 ** len(RULES) rows whatever the input, which are also all that the posterior needs.

Defined cases: a null or wordless text has all counts 0 and fails the base rule; an empty table has
no patterns and gives no rows; rows that repeat are counted and returned as often as they occur; a
null doc_id is returned as null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import stash
from quillstone.llm.docstats import with_statistics

#: Name -> (good if, bad if), SQL conditions over the statistics with w for n_words, at least 1. Shares are
#: per word, line or character, so that length decides only where a rule says so. Most kinds of junk
#: are looked at from two or three sides: agreement is all that EM can go by.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 30 and n_words <= 100000", "n_words < 20"),
    "word_length": ("word_chars >= 3 * w and word_chars <= 10 * w", "word_chars < 2 * w or word_chars > 15 * w"),
    "symbols": ("n_symbols * 100 <= w", "n_symbols * 10 > w"),
    "symbol_words": ("n_bare_words * 50 <= w", "n_bare_words * 10 > w"),
    "letters": ("(n_lower + n_upper + n_wide) * 100 >= word_chars * 93", "(n_lower + n_upper + n_wide) * 100 < word_chars * 88"),
    "dup_lines": ("n_dup_lines * 20 <= n_ink_lines", "n_dup_lines * 10 > n_ink_lines * 3"),
    "repeats": ("n_repeat_words * 20 <= w", "n_repeat_words * 5 > w"),
    "stutter": ("n_same_next * 50 <= w", "n_same_next * 10 > w"),
    "distinct": ("n_distinct_words * 5 >= w * 2", "n_distinct_words * 5 < w"),
    "capitals": ("n_caps_words * 20 <= w", "n_caps_words * 10 > w * 3"),
    "bangs": ("n_bangs * 20 <= w", "n_bangs * 10 > w * 3"),
}


def votes_of(stats: DataFrame) -> DataFrame:
    """`stats` with votes: a character per rule, 1 good, 0 bad, - abstains; bad goes before good."""
    w = stats.withColumn("w", F.greatest("n_words", F.lit(1)))
    code = F.concat(*(F.when(F.expr(bad), "0").when(F.expr(good), "1").otherwise("-") for good, bad in RULES.values()))
    return w.withColumn("votes", code).drop("w")


#: What is believed of every rule before its votes are seen, as shares of (abstain, bad, good) votes,
#: and how much that belief weighs, as a share of the documents.
PRIOR_GOOD, PRIOR_BAD, PRIOR_WEIGHT = (0.05, 0.02, 0.93), (0.05, 0.25, 0.70), 0.05


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each pattern (rows; -1 abstains), by EM over patterns with `counts`.

    Kinds of junk differ and seldom trip the same rule, so a start from the majority would take every
    lone vote for an error. It starts from doubt instead: a document with any vote against it is
    likelier bad; EM then gives each rule the trust that its agreement with the others earns it.
    """
    seen = votes >= 0
    post = np.where((votes == 0).any(1), 0.2, np.where((votes == 1).any(1), 0.95, 0.5))
    total = counts.sum()
    for _ in range(rounds):
        prior = ((counts * post).sum() + 1) / (total + 2)
        score = np.full(len(votes), np.log(prior) - np.log1p(-prior))
        for r in range(votes.shape[1]):
            tables = []
            for weight, belief in ((counts * post, PRIOR_GOOD), (counts * (1 - post), PRIOR_BAD)):
                by = np.array([weight[votes[:, r] == v].sum() for v in (-1, 0, 1)])
                by += np.array(belief) * (PRIOR_WEIGHT * total + 1)
                tables.append(by / by.sum())
            score += (np.log(tables[0]) - np.log(tables[1]))[votes[:, r] + 1] * seen[:, r]
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            return new
        post = new
    return post


def judge(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good."""
    spark = docs.sparkSession
    stats = stash(votes_of(with_statistics(docs)), "rules")
    patterns = stats.groupBy("votes").count().orderBy("votes").collect()  # 3 ** len(RULES) at most
    votes = np.array([["-01".index(x) - 1 for x in p["votes"]] for p in patterns], int).reshape(-1, len(RULES))
    post = fit(votes, np.array([p["count"] for p in patterns], float))
    table = spark.createDataFrame([(p["votes"], float(x)) for p, x in zip(patterns, post, strict=True)], "votes string, p_good double")
    failed = F.expr("n_words < 20 or n_repeat_words * 100 > n_words * 30")
    out = stats.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(*names, (~failed & (F.col("p_good") >= keep_from)).alias("kept"), "p_good")
