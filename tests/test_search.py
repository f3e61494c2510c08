"""The index of segments: what an update rewrites, that top-k is that of scoring everything, and that it reads less."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval
from quillstone.operators.search import SearchIndex, blocks, forward

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed, longest=60):
    rng = random.Random(seed)
    return {str(i): " ".join(WORDS[int(60 * rng.random() ** 3)] for _ in range(rng.randint(0, longest))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id string, text string").repartition(3)


def exhaustive(spark, docs, terms, k):
    docs = {i: t or "" for i, t in docs.items()}
    return [tuple(r) for r in retrieval.top(retrieval.bm25(frame(spark, docs), terms, "id"), k, 6).collect()]


def test_updates_keep_top_k_exact_and_rewrite_what_changed(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/ix", window=8, fan=3, least=50)
    docs, rng = texts(300, 1), random.Random(2)
    docs["null"] = None
    assert index.update(frame(spark, docs))[:2] == (301, 0)
    merged = 0
    for step in range(5):
        before = {s.number for s in index.segments()}
        changed = rng.sample(sorted(docs), 6)
        for i in changed[:3]:
            docs[i] = f"new{step} " + (docs[i] or "")
        for i in changed[3:]:
            del docs[i]
        docs[f"n{step}"] = "w1 w2 fresh"
        size = lambda i: len(set((docs[i] or "").split()))
        comes, goes, written = index.update(frame(spark, docs))
        assert (comes, goes) == (4, 6)
        own = sum(size(i) for i in [*changed[:3], f"n{step}"])
        merged += written > own
        assert written >= own and (before & {s.number for s in index.segments()} or written > own)
        for terms, k in ((["w0", "w1", "w50"], 7), (["fresh"], 1), (["w59", "absent"], 500))[: 3 if step > 2 else 1]:
            assert [tuple(r) for r in index.top(terms, k).rows.collect()] == exhaustive(spark, docs, terms, k)
    assert 0 < merged < 5
    assert index.update(frame(spark, docs)) == (0, 0, 0)
    assert index.live().count() == len(docs)
    assert index.vectors().count() == sum(bool((t or "").split()) for t in docs.values())
    assert index.vacuum(1) > 0
    assert [tuple(r) for r in index.top(["w0"], 5).rows.collect()] == exhaustive(spark, docs, ["w0"], 5)


def test_everything_gone_and_an_empty_index(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/ix")
    assert index.top(["a"], 3).rows.count() == 0
    assert index.update(frame(spark, {"1": "a b", "2": None})) == (2, 0, 2)
    assert index.update(frame(spark, {"1": "a b"}).where("false")) == (0, 2, 0)
    assert index.segments() == [] and index.top(["a"], 3).rows.count() == 0


def test_windows_that_cannot_reach_the_threshold_are_not_read(spark, tmp_path):
    docs = {f"d{i:04}": "common " + "filler " * (i % 50) for i in range(2000)} | {"best": "common common common rare"}
    index = SearchIndex(spark, f"file://{tmp_path}/ix")
    index.update(frame(spark, docs))
    found = index.top(["common", "rare"], 3)
    assert [tuple(r) for r in found.rows.collect()] == exhaustive(spark, docs, ["common", "rare"], 3)
    assert found.postings == 2002 and found.read < 200


def test_a_question_reads_its_own_terms_bounds(spark, tmp_path):
    """Blocks are met by pushed filters on the term, and bounds without the postings' columns."""
    index = SearchIndex(spark, f"file://{tmp_path}/ix")
    index.update(frame(spark, texts(50, 3)))
    rows = index._read("blocks", index.segments(), "term string, win long, n int, max_tf int, min_dl long, ids array<string>, tfs array<int>, dls array<long>")
    plan = rows.where(F.col("term").isin(["w1"])).groupBy("seg", "win").agg(F.sum("n"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan
    assert "ids" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("text", ["", "b a B a-c", "x " * 500, None, "É éİ 漢字"])
def test_forward_rows_count_terms(spark, text):
    from collections import Counter

    row = forward(spark.createDataFrame([("1", text)], "id string, text string")).first()
    words = spark.createDataFrame([(text,)], "text string").select(retrieval.tokens("text")).first()[0] or []
    assert dict(zip(row["terms"], row["tfs"], strict=True)) == dict(Counter(words)) and row["dl"] == len(words)


def test_blocks_hold_a_window_each(spark):
    own = forward(frame(spark, texts(100, 4)))
    rows = blocks(own, 8).collect()
    assert sum(r["n"] for r in rows) == sum(len(r["terms"]) for r in own.collect())
    for r in rows:
        assert r["n"] == len(r["ids"]) <= 8 and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_an_index_shuffles_once_by_blocks(spark):
    """Neither documents nor single terms are shuffled on the way to blocks, and no ranges are looked for ahead."""
    own = forward(frame(spark, texts(30, 5)).coalesce(1)).cache()
    plan = blocks(own)
    assert exchanges(plan) == exchanges(own) + 1 and "rangepartitioning" not in plan._jdf.queryExecution().toString()


def test_postings_are_shuffled_once_and_counted_by_their_shares(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b c d e f g h")], "doc_id long, text string").coalesce(1)
    index = retrieval.postings(docs)
    assert exchanges(index) == 1 and "rangepartitioning" not in index._jdf.queryExecution().toString()
    assert {tuple(r) for r in index.where("id < 4").collect()} == {("a", 1, 2, 3), ("b", 1, 1, 3), (None, 2, 0, 0), (None, 3, 0, 0)}
    assert tuple(retrieval.lengths(index).first()) == (4, 10)
    assert "count(distinct" not in retrieval.lengths(index)._jdf.queryExecution().toString()
