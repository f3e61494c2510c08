"""What walks move and hold: nothing that grows with the square of their rounds, no file's rows in one task."""

from quillstone.operators import paths
from quillstone.shared import told_apart

N = 20


def _shuffled(spark) -> int:
    """Records that stages of the session shuffled so far."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_what_was_reached_is_not_shuffled_again_each_round(spark, monkeypatch):
    monkeypatch.setattr(paths, "FRONT_ROWS", 0)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        edges = spark.createDataFrame([(i, "k", i + 1) for i in range(N)], "src long, edge string, dst long")
        seeds = spark.createDataFrame([(i,) for i in range(N)], "id long")
        began = _shuffled(spark)
        got = paths.walks("k+", edges, seeds)
        took = _shuffled(spark) - began
        assert sorted(map(tuple, got.collect())) == [(i, j, j - i) for i in range(N) for j in range(i + 1, N + 1)]
    finally:
        spark.conf.set(name, before)
    arcs, reached = 2 * N, N * (N + 1) // 2 + N
    assert took < arcs * (N + 3) + 4 * reached
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillstone_walks")]


def test_rows_are_dealt_before_they_are_told_apart(spark):
    rows = spark.range(10).selectExpr("id % 3 AS a", "id % 2 AS b")
    plan = told_apart(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    assert sorted(map(tuple, told_apart(rows).collect())) == [(a, b) for a in range(3) for b in range(2)]
