"""Mixing, spelling variants and vector codes against plain versions of themselves and their SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import codes, mixing, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(spark, name):
    """The query's rows over sf0.001 and those of its SQL."""
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, where)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    assert got


# --- vector codes -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, v string, code string, error string"


def plain_codes(rows, rounds=codes.ROUNDS):
    """(vec_id, label) -> rows of code and error, and the codebooks' digest, by full search."""
    whole = []
    for vec_id, e, label in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            whole.append((vec_id, label, [math.floor(1024 * x) for x in e]))
    length = max(Counter(len(v) for *_, v in whole).items(), key=lambda x: (x[1], x[0]))[0]
    whole = [r for r in whole if len(r[2]) == length]
    at = [i * length // 4 for i in range(5)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    books = [[r[2][i:j] for r in first] for i, j in itertools.pairwise(at)]
    nearest = lambda book, s: min((sum((a - b) ** 2 for a, b in zip(s, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p, (i, j) in enumerate(itertools.pairwise(at)):
            own = defaultdict(list)
            for r in whole:
                own[nearest(books[p], r[2][i:j])[1]].append(r[2][i:j])
            for k, parts in own.items():
                new[p][k] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
        books = new
    out = []
    for vec_id, label, v in whole:
        found = [nearest(books[p], v[i:j]) for p, (i, j) in enumerate(itertools.pairwise(at))]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    h = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((*r, total[r[1]], h) for r in out), key=repr)


def odd_vectors(scale=1.0, length=6):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, rng.random())) * scale for _ in range(length)], rng.choice((1, 2, None))) for i in range(400)]
    rows += rows[5:15] + [(7, [0.5 * scale] * length, 9), (None, [0.1] * length, None), (None, None, 1), (500, None, 2), (501, [None] + [0.0] * (length - 1), 1)]
    return rows + [(502, [math.nan] * length, 1), (503, [math.inf] * length, 1), (504, [0.5] * 3, 1), (505, [], 1), (-3, [0.1 * scale] * length, 1)]


@pytest.mark.parametrize("scale", [1.0, 50_000.0])  # in floats, and beyond what they hold exactly
def test_codes_are_those_of_full_search(spark, scale):
    rows = odd_vectors(scale)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).repartition(5)
    got = codes.compress(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    three = [(i, [float(i)] * 4, 1) for i in range(3)]
    df = spark.createDataFrame([(*r, "", "", "") for r in three], VECTORS)
    assert [(r["vec_id"], r["code"], r["error"]) for r in codes.compress(df).orderBy("vec_id").collect()] == [(0, "00000000", 0), (1, "01010101", 0), (2, "02020202", 0)]
    assert codes.compress(df.where("false")).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(df.where("false")).count() == 0
    assert codes.compress(df.withColumn("embedding", F.array().cast("array<double>"))).select("code").distinct().collect() == [("00000000",)]
    with pytest.raises(ValueError, match="beyond 64 bits"):
        codes.compress(df.withColumn("embedding", F.array(*[F.lit(1e9)] * 4)))


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_tree_search_keeps_lower_indexes_in_ties(kind):
    rng = np.random.default_rng(5)
    entries, points = rng.integers(-2, 3, (200, 3)).astype(kind), rng.integers(-3, 4, (3000, 3)).astype(kind)
    d = ((points[:, None] - entries) ** 2).sum(2)
    index, best = codes.Tree(entries).nearest(points)
    np.testing.assert_array_equal(index, d.argmin(1))
    np.testing.assert_array_equal(best, d.min(1))


def test_tree_search_passes_over_boxes(monkeypatch):
    rng = np.random.default_rng(6)
    tree, seen = codes.Tree(rng.normal(0, 100, (256, 2)).round()), []
    monkeypatch.setattr(tree, "leaf", type("L", (list,), {"__getitem__": lambda self, k: seen.append(k) or list.__getitem__(self, k)})(tree.leaf))
    tree.nearest(rng.normal(0, 100, (1, 2)))
    assert len(set(seen)) < len([c for c in tree.children if c is None]) / 2


def test_codes_equal_their_sql(spark):
    same_as_sql(spark, "op13_codes")


# --- mixing -------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight, those above their limit filled, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left = {}, share * sum(sizes.values())
    open_ = set(names)
    while open_:
        per = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * per > most * sizes[s]}
        if not full:
            return out | {s: w[s] * per for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def sized(docs):
    return docs.select("doc_id", "source", mixing.words_of("text").alias("size"))


def checked(mixed):
    """The mix's rows, after what must hold of any."""
    rows = mixed.collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert abs(taken[r["source"]] - r["target"]) <= largest[r["source"]] / 2 + 1e-6
    return rows


def test_mix_meets_its_targets(spark, odd, none, sample):
    docs = odd.unionByName(sample)
    rows = checked(mixing.mix(sized(docs), "size"))
    assert len(rows) == docs.count()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r["doc_id"]), len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect())
    assert mixing.mix(sized(none), "size").count() == 0


def test_mix_is_the_same_in_any_layout(spark, sample, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)  # so that the tree has levels
    docs = sized(sample.unionByName(sample.withColumn("doc_id", F.col("doc_id") + 1000)))
    one, two = (sorted(map(tuple, mixing.mix(docs.repartition(n, *by), "size").select("doc_id", "taken").collect())) for n, by in ((3, ["doc_id"]), (7, ["size"])))
    assert one == two
    checked(mixing.mix(docs, "size"))
    assert one != sorted(map(tuple, mixing.mix(docs, "size", seed=1).select("doc_id", "taken").collect()))


def test_mix_of_one_hot_kind_of_row(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 2900, "a").otherwise("b").alias("source"), F.lit(7).cast("long").alias("size"))
    rows = checked(mixing.mix(docs.repartition(6), "size"))
    assert len(rows) == 3000 and abs(sum(r["taken"] for r in rows) - 1.5 * 21000) <= 14


def test_mix_carries_columns_and_repeats_rows(spark, clashing):
    docs = clashing.withColumns({"size": mixing.words_of("text"), "number": F.lit("x"), "x": F.lit("y"), "target": F.lit(1)})
    mixed = mixing.mix(docs, "size")
    assert set(docs.columns) | {"source_size", "copies", "taken"} == set(mixed.columns)
    assert mixing.repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    assert {r["n"] for r in mixed.collect()} == {"clash"}


def test_rounding_keeps_sums_and_chances():
    rng = np.random.default_rng(1)
    n, runs = 12, 4000
    size, x = rng.integers(1, 50, n), rng.random(n)
    group = np.repeat([0, 1], n // 2)
    mean = np.zeros(n)
    for r in range(runs):
        key = mixing.scramble(np.arange(n, dtype=np.uint64) + np.uint64(r * n))
        out = mixing.settle(group, size, x, key, np.zeros(n, np.int64))
        for g in (0, 1):
            own = group == g
            assert ((out[own] > 0) & (out[own] < 1)).sum() <= 1
            assert (out * size)[own].sum() == pytest.approx((x * size)[own].sum())
        mean += out / runs
    np.testing.assert_allclose(mean, x, atol=0.04)


def test_word_counts_are_those_of_the_pattern(spark):
    texts = ["a b c", "\x0b x\x0cy z ", "", None, " "]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.words_of("text")).collect()
    assert [r[0] for r in got] == [2, 2, 0, 0, 0]


# --- spelling variants --------------------------------------------------------------------------


def near_words(words):
    """word -> near words, from every deletion and replacement."""
    near, gaps = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            v = w[:k] + w[k + 1 :]
            if v in words:
                near[w].add(v)
                near[v].add(w)
            gaps[k, v].add(w)
    for g in gaps.values():
        for a, b in itertools.permutations(g, 2):
            near[a].add(b)
    return near


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[spelling.without(w, h % len(w)) if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near, form = near_words(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize(("group", "size"), [(4, 1 << 20), (50_000, 60), (50_000, 8 << 20)])  # the top's levels by words, by bytes, none
def test_variants_are_the_plain_ones(spark, odd, sample, group, size):
    rng = random.Random(4)
    words = ["".join(rng.choice("aéÉb") for _ in range(rng.randint(6, 9))) for _ in range(150)]
    texts = [" ".join(rng.choice(words[: 1 + int(150 * rng.random() ** 3)]) for _ in range(40)) for _ in range(40)]
    base = "committee " * 200 + "comittee comittee comitee " + "commitee " * 12 + "xcommittee committeex " * 2
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*texts, base, "y" * 5000 + " " + "y" * 5001, "y" * 5000 + "-" + "y" * 5001])] + [(None, base, None, None, None)], DOCS)
    docs = odd.unionByName(more).unionByName(sample.limit(20))
    got = sorted(tuple(r) for r in spelling.variants(docs, group=group, group_bytes=size).collect())
    assert got == plain_variants((r["doc_id"], r["text"]) for r in docs.collect())
    assert any(r[1] and r[2] != r[1] for r in got) and any(r[4] > 3 for r in got)


def test_variants_of_no_rows_and_clashing_names(spark, none, clashing, odd):
    assert spelling.variants(none).count() == 0
    assert sorted(map(str, spelling.variants(clashing).collect())) == sorted(map(str, spelling.variants(odd).collect()))


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\xe9"])
def test_one_edit_pairs_are_all_and_once(alphabet):
    rng = random.Random(len(alphabet))
    words = sorted({bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 7))) for _ in range(300)})
    got = [frozenset(p) for p in spelling.one_edit_pairs(words)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a, near in near_words(set(words)).items() for b in near}


def test_runs_and_checksums_of_stepped_texts(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abÀÿ×漢 \U0001f600ĀZ") for _ in range(3000)).encode()
    buf, whole = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, length = spelling.letter_runs(buf, whole)
    found = list(re.finditer("[A-Za-zÀ-ÿ]+", text.decode()))
    assert [text[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [m.group() for m in found]
    assert length.tolist() == [len(m.group()) for m in found]
    before = np.full(len(starts), zlib.crc32(b"12:"), np.int64)
    assert spelling.checksums(buf, starts, ends, before).tolist() == [zlib.crc32(b"12:" + text[a:b]) for a, b in zip(starts, ends, strict=True)]
    monkeypatch.setattr(spelling, "SLICE_BYTES", 64)
    pieces = []
    for _, data, off in spelling._steps(buf, whole):
        s, e, _ = spelling.letter_runs(data, off)
        pieces += [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)]
    assert pieces == [m.group() for m in found]


def test_variants_equal_their_sql(spark):
    same_as_sql(spark, "op12_spelling")
