"""PPM against brute force; classifiers by held-out accuracy; rules by recovered accuracies."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import docstats, ppm, quality, rules, toxicity

from .conftest import rows


def brute_ppm(table, order=ppm.ORDER):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words, trie = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for i, t in table:
        if held(i):
            continue
        b = (t or "").encode().lower()
        words.update(b.split())
        words[None] += 1
        s = b"\xfe" * order + b + b"\xff"
        for p in range(order, len(s)):
            for k in range(order + 1):
                trie[k][s[p - k : p]][s[p]] += 1
    n, v = sum(words.values()), len(words)
    for i, t in table:
        b = (t or "").encode().lower()
        own = [*b.split(), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        s, total = b"\xfe" * order + b + b"\xff", 0.0
        for p in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                seen = trie[k].get(s[p - k : p])
                if not seen:
                    continue
                free, kinds = sum(c for x, c in seen.items() if x not in gone), len(set(seen) - gone)
                if s[p] in seen:
                    total += math.log10(seen[s[p]] / (free + kinds))
                    break
                if kinds:
                    total += math.log10(kinds / (free + kinds))
                gone = set(seen)
            else:
                total -= math.log10(256 - len(gone))
        yield i, held(i), len(own), sum(words[w] > 0 for w in own), n, base, total


@pytest.mark.parametrize("which", ["odd", "clashing", "sample"])
def test_ppm(request, which):
    docs = request.getfixturevalue(which)
    if which == "sample":
        docs = docs.where("length(text) < 3000")
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    got = sorted((tuple(r) for r in ppm.score(docs).collect()), key=key)
    want = sorted(brute_ppm(table), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_ppm_is_a_distribution():
    """Over all bytes after a context, probabilities sum to 1."""
    low_text = b"abracadabra abracad "
    import pyarrow as pa

    buf, off = ppm.buffer_of(pa.array([low_text], pa.binary()))
    seen, n = ppm._counted(ppm.grams(buf, off)[0])
    for context in (b"abrac", b"zzabr", b"qqqqq", b"cadab"):
        head = np.uint64(int.from_bytes(context, "big") << 8)
        keys = np.unique(np.concatenate([seen, head | np.arange(256, dtype=np.uint64)]))
        c = np.zeros(len(keys), np.int64)
        c[np.searchsorted(keys, seen)] = n
        low_keys, inverse = np.unique(keys & np.uint64((1 << 8 * ppm.ROOT) - 1), return_inverse=True)
        low = ppm._Ladder(low_keys, np.bincount(inverse, c).astype(np.int64), ppm.ROOT - 1, 0)
        cost = ppm.code_lengths(keys, c, low)
        assert abs((10.0 ** cost[keys >> np.uint64(8) == head >> np.uint64(8)]).sum() - 1) < 1e-9


def test_ppm_no_rows(spark, none):
    assert ppm.score(none).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = ppm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and abs(only["score"] + 3 * math.log10(256)) < 1e-9


@pytest.fixture(scope="module")
def labelled(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def held_out(scored, labels, column):
    found = scored.where("held_out").join(labels, "doc_id").select("predicted", column, "score").collect()
    return np.array([(r[0], r[1], r[2]) for r in found])


def test_quality(labelled):
    docs, labels = labelled
    got = held_out(quality.score(docs, labels), labels, "quality")
    assert (got[:, 0] == got[:, 1]).mean() > 0.95 and got[:, 2].min() >= 0 and got[:, 2].max() <= 1


def test_toxicity(spark):
    """Insults in unseen spellings and inflections, few words in long texts."""
    rng = np.random.default_rng(3)
    clean = ["house", "river", "walk", "bread", "window", "garden", "letter", "music", "evening", "paper"]
    stems, ends = ["stupid", "blorg"], ["", "o", "er", "ina", "ung", "esk", "ly"]
    table, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, rng.integers(20, 200)))
        toxic = i % 4 == 0
        if toxic:
            held = zlib.crc32(str(i).encode()) % 3 == 1
            for _ in range(2):
                words.insert(rng.integers(len(words)), str(rng.choice(stems)) + str(rng.choice(ends[4:] if held else ends[:4])))
        table.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = held_out(toxicity.score(docs, labels), labels, "toxic")
    assert (got[:, 0] == got[:, 1]).mean() > 0.95
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 450) < 15


@pytest.mark.parametrize("which", ["odd", "clashing"])
def test_classifiers_take_odd_rows(request, spark, which):
    docs = request.getfixturevalue(which)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (7, 0, 1), (9, 1, 1), (None, 1, 1), (99, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for scored in (quality.score(docs, labels), toxicity.score(docs, labels)):
        got = scored.collect()
        assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got)
    none_ = labels.where("false")
    assert {r["score"] for r in toxicity.score(docs, none_).collect()} == {0.5} and {r["score"] for r in quality.score(docs, none_).collect()} == {0.5}
    assert toxicity.keep_clean(docs, none_).columns == docs.columns


def test_no_documents(spark, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(none, labels).collect() == toxicity.score(none, labels).collect() == rules.judge(none).collect() == []


def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@pytest.mark.parametrize("which", ["odd", "clashing", "sample"])
def test_rules(request, which):
    docs = request.getfixturevalue(which)
    got = rules.judge(docs).collect()
    want = []
    for r in docs.collect():
        n = brute_statistics(r["text"])
        want.append(str((r["doc_id"], *n, n[0] < 20 or 100 * n[4] > 30 * n[0])))
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(want)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_statistics_of_edges():
    import pyarrow as pa

    for text in ("", "\n", "a\na\na", "a\n\na\n", " a\na", "a a a a a a a a a a", "x\r\ny\r\nx\r\n", "\na"):
        buf, off = docstats.buffer_of(pa.array([text.encode(), b"other", text.encode()], pa.binary()))
        got = docstats.statistics(buf, off)
        want = brute_statistics(text)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(int(got[k][0]) for k in names) == tuple(int(got[k][2]) for k in names) == want, text


def test_em_recovers_bad_documents():
    rng = np.random.default_rng(0)
    good = rng.random(5000) < 0.85
    votes = np.stack([np.where(rng.random(5000) < 0.2, -1, np.where(rng.random(5000) < (0.97 if r < 4 else 0.7), good, ~good).astype(int)) for r in range(6)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = rules.fit(patterns, counts.astype(float))[inverse.ravel()]
    assert ((post > 0.5) == good).mean() > 0.97


def test_quality_and_rules_agree_on_repeats(odd):
    assert len(rows(rules.judge(odd.unionAll(odd)))) == 28
