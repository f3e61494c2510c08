"""Models and searches against plain versions of themselves, and a 100 MB text within bounded memory."""

import math
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quillstone.llm import docstats, licenses, quality, rules, toxicity

SEED = 0xFFFFFFFFFFFFFFFF


def plain_mix(x):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> 33
        x = x * c & SEED
    return x ^ x >> 33


def plain_word(model, word):
    """A word's logit: the mean of its n-grams' weights."""
    text, got = f"<{word.strip(toxicity._EDGES.decode())}>", []
    for n in toxicity.GRAM_SIZES:
        for i in range(len(text) - n + 1):
            value = n
            for c in text[i : i + n]:
                value = (value * 0x100000001B3 + ord(c)) & SEED
            got.append(float(model.weight[plain_mix(value) % toxicity.BUCKETS]))
    return sum(got) / len(got) if got else 0.0


def plain_score(model, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) or [""]
    logits = [plain_word(model, w) for w in words]
    windows = [np.mean(logits[i : i + toxicity.WINDOW]) for i in range(0, len(logits), toxicity.WINDOW)]
    share = [math.exp(x) for x in windows]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(share, windows, strict=True)) / sum(share) + model.bias)))


def test_toxicity_scores_are_the_plain_ones(odd, sample):
    texts = [(r["text"] or "")[:3000] for r in odd.unionAll(sample).collect()]
    rng = np.random.default_rng(2)
    model = toxicity.Model(-0.3)
    model.weight = rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    raw = [t.encode() for t in texts]
    got = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    np.testing.assert_allclose(got, [plain_score(model, t) for t in texts], rtol=1e-5)


def test_toxicity_of_a_long_text_is_that_of_its_steps(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.Model(0.1)
    model.weight = rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    buf = np.frombuffer(b" ".join(rng.choice(list(b"abcdef"), 4).astype(np.uint8).tobytes() for _ in range(3001)), np.uint8)
    whole = model.score(buf, np.array([0, len(buf)]))
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1024)
    np.testing.assert_allclose(model.score(buf, np.array([0, len(buf)])), whole, rtol=1e-9)


def plain_trees(x, y, model):
    """Predictions of trees grown by trying every cut of every feature in every node."""
    n, out = len(y), np.zeros(len(y))
    raw = np.full(n, model.start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, model.bins + 1)[1:-1], method="higher")) for f in range(x.shape[1])]

    def grow(rows, g, h, depth):
        value = -model.rate * g[rows].sum() / (h[rows].sum() + model.ridge)
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth < model.depth else []:
            for cut in cuts[f]:
                left, right = [r for r in rows if x[r, f] <= cut], [r for r in rows if x[r, f] > cut]
                if min(h[left].sum(), h[right].sum()) < model.least * 0.1:
                    continue
                gain = sum(g[p].sum() ** 2 / (h[p].sum() + model.ridge) for p in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + model.ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        if best[1] is None:
            out[rows] = value
        else:
            for part in best[1]:
                grow(part, g, h, depth + 1)

    for _ in range(model.trees):
        p = 1 / (1 + np.exp(-raw))
        grow(list(range(n)), p - y, np.maximum(p * (1 - p), 1e-6), 0)
        raw = raw + out
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trees_are_those_of_all_cuts(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.3, 80) > 0.3).astype(float)
    model = quality.Trees(trees=4, depth=3, bins=8).fit(x, y)
    np.testing.assert_allclose(model.predict(x), plain_trees(x, y, model), rtol=1e-9)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper = lambda c: "A" <= c <= "Z"
    return {
        "n_words": len(words),
        "w": max(len(words), 1),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_ink_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}),
        "n_bare_words": sum(x[-1] in "#*$%&|<>" for x in words),
        "n_same_next": sum(a == b for a, b in zip(words, words[1:])),
        "n_distinct_words": len(set(words)),
        "n_caps_words": sum(len(x.encode()) > 1 and upper(x[0]) and upper(x[1:2]) for x in words),
        "n_lower": len(re.findall("[a-z]", text)),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_wide": sum(ord(c) > 127 for c in text),
        "n_bangs": len(re.findall("[!?]", text)),
    }


def plain_verdicts(texts):
    """p_good per text: votes by Python, then EM over texts one by one."""
    stats = [plain_statistics(t) for t in texts]
    votes = [[0 if eval(bad, {}, s) else 1 if eval(good, {}, s) else -1 for good, bad in rules.RULES.values()] for s in stats]
    post = [0.2 if 0 in v else 0.95 if 1 in v else 0.5 for v in votes]
    for _ in range(200):
        prior = (sum(post) + 1) / (len(post) + 2)
        trust = []
        for r in range(len(rules.RULES)):
            both = []
            for weight, belief in ((post, rules.PRIOR_GOOD), ([1 - p for p in post], rules.PRIOR_BAD)):
                by = [sum(w for w, v in zip(weight, votes, strict=True) if v[r] == k) + b * (rules.PRIOR_WEIGHT * len(post) + 1) for k, b in zip((-1, 0, 1), belief, strict=True)]
                both.append([x / sum(by) for x in by])
            trust.append([math.log(a) - math.log(b) for a, b in zip(*both, strict=True)])
        new = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(t[x + 1] for t, x in zip(trust, v, strict=True) if x >= 0)))) for v in votes]
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        post = new
        if done:
            break
    return [(s["n_words"] < 20 or s["n_repeat_words"] * 100 > s["n_words"] * 30, p) for s, p in zip(stats, post, strict=True)]


def test_verdicts_are_those_of_plain_em(spark, sample):
    texts = [r["text"] or "" for r in sample.collect()]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (failed, p) in enumerate(plain_verdicts(texts)):
        assert got[i]["base_failed"] == failed and abs(got[i]["p_good"] - p) < 1e-6 and got[i]["kept"] == (not failed and p >= 0.5), texts[i][:80]


def test_statistics_are_the_plain_ones(odd, sample):
    texts = [r["text"] or "" for r in odd.unionAll(sample).collect()]
    raw = [t.encode() for t in texts]
    got = docstats.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert {k: int(got[k][i]) for k in want if k != "w"} == {k: v for k, v in want.items() if k != "w"}, t[:80]


def test_licenses_are_found_wherever_they_are():
    """Regions around rare words against aligning the template at every place."""
    rng = np.random.default_rng(7)
    template = [f"t{k}" if k % 3 else "the" for k in range(24)]
    scanner = licenses.Scanner({"x": " ".join(template)}, 0.8)
    slack = len(template) // 4 + 2
    found = missed = 0
    for _ in range(300):
        own = [w for w in template if rng.random() > rng.choice([0.0, 0.1, 0.25])]
        words = [*rng.choice(["the", "a", "t1", "t5", "z"], rng.integers(0, 40)), *own, *rng.choice(["the", "a", "t2", "z"], rng.integers(0, 40))]
        text = [w.encode() for w in words]
        wanted = [w.encode() for w in template]
        best = max(len(licenses.align(text[i : i + len(template) + 2 * slack], wanted)) for i in range(max(1, len(text))))
        got = scanner.scan(" ".join(words).encode())
        assert not got or best >= 0.8 * len(template)
        missed += not got and best >= 0.8 * len(template)
        for _, share, a, b in got:
            assert len(licenses.align(text[a:b], wanted)) >= 0.8 * len(template) and share >= 0.8
            found += 1
    # Where the words around a copy are the template's own, an alignment depends on where its region begins.
    assert found > 100 and missed <= found // 50


def test_frequent_grams_take_bounded_memory():
    """An item and a long text of the same few q-grams: every place of one meets every place of the other."""
    from quillstone.llm import decontaminate

    item = b"0123456789" * 40
    index = decontaminate.Index([(1, item), (2, b"=" * 300), (3, bytes(range(97, 117)) * 5)])
    noise = np.random.default_rng(0).integers(97, 123, 300_000).astype(np.uint8).tobytes()
    texts = [b"=" * 300_000 + noise, noise + bytes(range(97, 117)) * 5 + noise, (b"0123456789" * 30_000)[:-5] + noise, noise]
    got = index.search(*decontaminate.normalised(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    assert sorted(got) == [(0, 1), (1, 2), (2, 0)]


def test_full_license_texts():
    long = {n: t for n, t in licenses.TEMPLATES.items() if len(t.split()) > 60}
    assert {"MIT-text", "BSD-3-text", "ISC-text"} <= set(long)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    for name, text in long.items():
        got = scanner.scan(("Some words before. " + text.replace(" ", "\n# ", 5) + " And after.").encode())
        assert name in {n for n, *_ in got}, (name, got)


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
from quillstone.llm import decontaminate, docstats, neardup, pii, ppm, toxicity
rng = np.random.default_rng(0)
words = [rng.choice(list(b"abcdefghij"), 5).astype(np.uint8).tobytes() for _ in range(5000)]
one = b" ".join(words[i] for i in rng.integers(0, 5000, 175_000))[: 1 << 20]
buf, off = np.tile(np.frombuffer(one, np.uint8), 100), np.array([0, 100 << 20])
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "docstats":
    assert docstats.statistics(buf, off)["n_chars_all"][0] == 100 << 20
elif sys.argv[1] == "neardup":
    assert neardup.registers(neardup.shingle_sets(buf, off, 4)[0]).all()
elif sys.argv[1] == "decontaminate":
    assert decontaminate.Index([(1, one[1000:1300])]).search(*decontaminate.normalised(buf, off)) == [(0, 0)]
elif sys.argv[1] == "toxicity":
    assert abs(toxicity.Model(0.0).score(buf, off)[0] - 0.5) < 1e-9
elif sys.argv[1] == "pii":
    assert pii.all_spans(buf.tobytes().decode()) == []
else:
    text = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(buf)])
    rows = ppm._packed(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([False]), text], ["doc_id", "held", "text"]))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([rows], pa.binary())], ["g", "rows"])
    assert sum(int(np.asarray(b.column("c")).sum()) for b in ppm._tally([batch]) if b.column("kind")[0].as_py() == 0) == (100 << 20) + 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("which", ["docstats", "neardup", "decontaminate", "toxicity", "pii", "ppm"])
def test_a_text_of_100_mb(which):
    """Within 2 GB beside the text itself, which is what an executor's workers may be given."""
    done = subprocess.run([sys.executable, "-c", LONG, which], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[2])
    assert done.returncode == 0 and int(done.stdout) < 2000, (done.stdout, done.stderr[-2000:])
