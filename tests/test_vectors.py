"""The approximate vector index against full scans."""

import numpy as np
import pytest

from quillstone.operators import vectors
from quillstone.operators.vectors import VectorIndex
from quillstone.plans.catalog import QUERIES


def clustered(n, size, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, size))
    return [(i, (centres[i % 12] + rng.normal(0, 0.4, size)).tolist()) for i in range(n)]


def true_top(rows, q, k):
    x = np.array([r[1] for r in rows])
    s = x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return [str(rows[i][0]) for i in sorted(range(len(rows)), key=lambda i: (-round(s[i], 9), str(rows[i][0])))[:k]]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(1500, 18)  # 18 is no multiple of a part
    odd = [(9001, None), (9002, [0.0] * 18), (9003, [float("nan")] * 18), (9004, [1.0]), (9005, [None] * 18)]
    index = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('vx')}")
    assert index.build(spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>").repartition(4)) == len(rows)
    return index, rows


def test_recall_and_bytes(spark, built):
    index, rows = built
    asked = [r for r in rows if r[0] % 100 == 0]
    got = index.search(spark.createDataFrame(asked, "vec_id int, embedding array<double>"), 10).collect()
    by = {str(i): {r["id"] for r in got if r["qid"] == str(i)} for i, _ in asked}
    hits = sum(len(by[str(i)] & set(true_top(rows, np.array(v), 10))) for i, v in asked)
    assert hits >= 0.9 * 10 * len(asked)
    used, whole = index.cost(asked[0][1], 10)
    assert used < whole / 3 and index.probes < 20


def test_exact_search_is_the_full_scan(spark, built):
    index, rows = built
    asked = [rows[3], (77, (np.array(rows[5][1]) * 9).tolist())]
    got = index.search(spark.createDataFrame(asked, "vec_id int, embedding array<double>"), 7, exact=True).orderBy("qid", "score").collect()
    for i, v in asked:
        assert {r["id"] for r in got if r["qid"] == str(i)} == set(true_top(rows, np.array(v), 7))
        assert {r["id"] for r in index.top(v, 7, exact=True).collect()} == set(true_top(rows, np.array(v), 7))


def test_one_query_reads_its_lists_alone(built):
    index, rows = built
    got = index.top(rows[0][1], 5)
    assert got.first()["id"] == "0" and got.first()["score"] == pytest.approx(1, abs=1e-6)
    assert "In(list, [" in index.search(index.spark.createDataFrame([rows[0]], "vec_id int, embedding array<double>"), 5, lists=[1, 2])._jdf.queryExecution().toString()
    assert index.top([0.0] * 18, 5).count() == 0


def test_a_hot_list_is_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = clustered(60, 8) + [(1000 + i, [1.0] * 8) for i in range(200)]
    index = VectorIndex(spark, f"file://{tmp_path}/vx")
    index.build(spark.createDataFrame(rows, "vec_id int, embedding array<double>"))
    blocks = index._table("lists", "list int, block int, n long").groupBy("list").count().toPandas()
    assert blocks["count"].max() >= 10
    got = index.top([1.0] * 8, 30).collect()
    assert [r["id"] for r in got] == sorted(str(1000 + i) for i in range(200))[:30]


def test_no_vectors(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/vx")
    empty = spark.createDataFrame([], "vec_id int, embedding array<double>")
    assert index.build(empty) == 0
    assert index.search(empty, 3).count() == 0 and index.top([1.0], 3).count() == 0


def test_means_are_those_of_plain_rounds(spark):
    points = np.array([r[1] for r in clustered(200, 6, 4)])
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>").repartition(3)
    book = points[:5]
    (got,) = vectors.fit(rows, [book], [0, 6], rounds=3)
    for _ in range(3):
        to = ((points[:, None] - book) ** 2).sum(2).argmin(1)
        book = np.array([points[to == e].mean(0) if (to == e).any() else book[e] for e in range(5)])
    np.testing.assert_allclose(got, book, rtol=1e-9)


def test_probes_are_measured_by_vectors_that_nothing_began_as(spark, tmp_path, monkeypatch):
    seen, real = [], vectors.probes_for
    monkeypatch.setattr(vectors, "probes_for", lambda placed, centres, asked: (seen.append(asked), real(placed, centres, asked))[1])
    rows = clustered(400, 8, 3)
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/vx")
    index.build(df)
    unit = VectorIndex._unit(df, "vec_id", "embedding")
    began = np.array([r["v"] for r in unit.orderBy(vectors.F.xxhash64("id"), "id").limit(vectors.ENTRIES).collect()])
    assert len(seen[0]) == vectors.SAMPLE and not (seen[0][:, None] == began).all(2).any()
    assert index.refine >= vectors.REFINE


def test_a_small_table_is_not_ranked_again_whole(spark, tmp_path):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(0, 1, (500, 64)))]  # hardly clustered, so most lists are probed
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/vx")
    index.build(df)
    used, whole = index.cost(rows[0][1], 20)
    assert used < 0.25 * whole
    asked = df.where("vec_id % 100 = 0")
    assert {(r["qid"], r["read"] < 0.25 * r["whole"], r["least"]) for r in index.costs(asked, 20).collect()} == {(str(i), True, 20 * 264) for i in range(0, 500, 100)}
    for k in (1, 5, 20):  # fewer answers are ranked among as many candidates
        found, true = ({(r["qid"], r["id"]) for r in index.search(asked, k, exact=e).collect()} for e in (False, True))
        assert len(found & true) >= 0.9 * len(true)


@pytest.mark.parametrize("n", [0, 40])
def test_recall_and_fraction_of_tables_with_few_vectors(spark, tmp_path, n):
    spark.createDataFrame(clustered(n, 16, 7) + [(100, None)] * (n > 0), "vec_id int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["vector_index_recall"](spark, str(tmp_path)).select("queries", "recalled", "fraction").collect()] == [(2 if n else 0, True, True)]
