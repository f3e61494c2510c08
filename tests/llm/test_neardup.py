"""Near duplicates against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import neardup

from .conftest import rows


def components(docs, width, percent):
    """{row index: (set size, smallest row index reachable)} by comparing all pairs."""
    sets = []
    for text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    at = list(range(len(docs)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def expected(table, width=4, percent=80):
    got = components([t for _, t in table], width, percent)
    ids = defaultdict(list)
    for (doc_id, _), (_, c) in zip(table, got, strict=True):
        if doc_id is not None:
            ids[c].append(doc_id)
    out = []
    for (doc_id, _), (n, c) in zip(table, got, strict=True):
        least = (doc_id if n == 0 else min(ids[c])) if n == 0 or ids[c] else None
        out.append(str((doc_id, n, least, doc_id == least if doc_id is not None else least is None)))
    return sorted(out)


def test_odd_rows(odd, clashing):
    want = expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert rows(neardup.near_duplicates(odd)) == want
    assert rows(neardup.near_duplicates(clashing)) == want


def test_sample(sample):
    assert rows(neardup.near_duplicates(sample)) == expected([(r["doc_id"], r["text"]) for r in sample.collect()])


def test_chain_and_residue(spark):
    """Variants of one text around the threshold: many classes share buckets, few pairs link directly."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    table = []
    for k in range(60):
        own = list(base)
        for p in rng.choice(120, 1 + k % 6, replace=False):
            own[p] = f"v{k}-{p}"
        table.append((k, " ".join(own)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(neardup.near_duplicates(docs)) == expected(table)


    assert rows(neardup.near_duplicates(docs, exact=True)) == expected(table)


def test_every_link_of_a_larger_table(spark):
    """No link is missed among all pairs of sf0.01, by bands or by prefixes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(neardup.near_duplicates(docs)) == want


def test_prefixes_meet():
    rng = np.random.default_rng(3)
    for n in (4, 5, 9, 40, 101):
        for _ in range(200):
            a = np.unique(rng.integers(0, 10 * n, n).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[: -(-9 * len(a) // 10)], rng.integers(0, 10 * n, n // 9).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert np.intersect1d(neardup.prefix(a, 80), neardup.prefix(b, 80)).size


def test_no_rows(none):
    assert neardup.near_duplicates(none).collect() == []
    assert neardup.keep_one(none).collect() == []


def test_keep_one(odd, clashing):
    kept = neardup.keep_one(odd, width=4)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "10", "11", "4", "5", "6", "7", "9", "None", "None"]
    assert neardup.keep_one(clashing, width=4).columns == clashing.columns


@pytest.mark.parametrize("size", [5, 40, 300, 5000])
def test_estimate(size):
    rng = np.random.default_rng(size)
    shared = rng.integers(0, 2**64, int(size * 0.8), np.uint64)
    own = [np.unique(np.concatenate([shared, rng.integers(0, 2**64, size // 5 // 2 + 1, np.uint64)])) for _ in "ab"]
    true = len(np.intersect1d(*own)) / len(np.union1d(*own))
    a, b = (neardup.registers(x)[None] for x in own)
    n = [np.array([len(x)]) for x in own]
    got, seen = neardup.estimate(a, b, *n)
    assert abs(got[0] - true) < 5 * np.sqrt(0.25 / max(seen[0], 1))
    assert neardup.plausible(a, b, *n, 80)[0] or true < 0.8


def test_collisions_are_corrected():
    rng = np.random.default_rng(1)
    a, b = (neardup.registers(np.unique(rng.integers(0, 2**64, 4000, np.uint64)))[None] for _ in "ab")
    got, _ = neardup.estimate(a, b, np.array([4000]), np.array([4000]))
    assert abs(got[0]) < 0.02


def test_keep_one_keeps_rows_without_id_and_words(spark):
    docs = [(None, None), (None, ""), (None, ""), (None, " \n"), (None, " \n"), (1, ""), (1, ""), (None, "a b c d e f g"), (None, "a b c d e f g")]
    kept = neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [*docs[:6], docs[7]])
