"""Tasks that keep their size: rows dealt by their number, differences of tables in one pass."""

from caseflow.operators import review as R
from caseflow.plans import catalogue, registry
from tests.session import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_rows(spark):
    x = spark.range(1000).selectExpr("id % 50 AS k", "id")
    assert registry.spread(x, "k", each=100).rdd.getNumPartitions() == 11
    assert registry.spread(x.where("false"), "k").rdd.getNumPartitions() == 1
    for name in ("frozen_differences", "gap_cost", "gap_rates", "gap_progress"):
        assert "REPARTITION_BY_NUM" in _plan(catalogue.queries()[name](spark, SMALL)), name


def test_differences_in_one_pass(spark):
    saved = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (3, "c")], "k long, v string")
    rebuilt = spark.createDataFrame([(1, "a"), (2, None), (2, None), (4, "d")], "k long, v string")
    out = R.frozen_differences(saved, rebuilt, ["k", "v"])
    assert out.columns == ["k", "v", "side"] and _plan(out).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a", "saved"), (1, "a", "saved"), (2, None, "rebuilt"), (3, "c", "saved"), (4, "d", "rebuilt")]
