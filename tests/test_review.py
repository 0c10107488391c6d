"""Review operators on small tables with nulls, ties, single rows and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import review as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pairs_repeat_a_last_frame_without_partner(spark):
    frames = spark.createDataFrame([("a", i) for i in range(3)], "case string, i long")
    assert rows(R.pairs(frames, "case", "i", 2.0)) == [("a", 0, 0, 1, False, "<0.2 seconds>"), ("a", 1, 2, 2, True, "<1.0 seconds>")]
    assert rows(R.pairs(frames.where("i < 0"), "case", "i", 2.0)) == []


def test_extent_takes_the_last_known_basis(spark):
    data = [("own", 1, 0, None), ("own", 2, 10, 4), ("before", 1, 0, 9), ("before", 2, 7, 0), ("one", 1, 5, None)]
    x = spark.createDataFrame(data, "case string, i int, pts int, own int")
    assert rows(R.extent(x, "case", "i", "pts", "own")) == [("before", 14, "previous_interval"), ("one", 0, "unknown"), ("own", 14, "own_duration")]


def test_matched_errors_leave_missing_parts_out(spark):
    schema = "f int, tip struct<x:double,y:double>, box struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([(1, (0.0, 0.0), None), (2, None, (0.0, 0.0, 1.0, 1.0)), (3, (0.5, 0.5), None)], schema).withColumn("k", F.lit("all"))
    found = spark.createDataFrame([(1, (0.3, 0.4), (0.0, 0.0, 1.0, 1.0)), (2, (0.1, 0.1), (0.0, 0.0, 0.5, 1.0))], schema)
    assert rows(R.matched_errors(truth, found, ["f"], ["k"], 1.0)) == [("all", 2, 0.5, 0.5)]


def test_box_cells_of_small_and_large_boxes(spark):
    x = spark.createDataFrame([("small", (0.26, 0.26, 0.3, 0.3)), ("edge", (1.0, 1.0, 1.0, 1.0)), ("half", (0.0, 0.0, 0.5, 1.0))], "k string, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert rows(R.box_cells(x, ["k"], F.col("b"), 4, 2)) == [("edge", 1, 3), ("half", 0, 0), ("half", 0, 1), ("half", 1, 0), ("half", 1, 1), ("small", 0, 1)]


def test_rejected_items_and_searches(spark):
    items = spark.createDataFrame([("r", 1, "a", "x"), ("r", 2, "a", "x"), ("r", 3, None, "x"), ("r", 4, "b\n", "x"), ("r", 5, "c", None), ("s", 1, "a", "x")], "run string, n int, id string, why string")
    assert rows(R.rejected_items(items, "run", "n", "id", F.lit(True), "why")) == [("r", 2, "duplicate_id"), ("r", 3, "invalid_id"), ("r", 4, "invalid_id"), ("r", 5, "unexplained")]
    searches = spark.createDataFrame([("r", 1, "Q ", 1, 2), ("r", 2, "q", 1, 2), ("r", 3, "q", 2, 1), ("r", 4, "q", 1, None), ("r", 5, "q", 0, 2)], "run string, n int, q string, a int, b int")
    assert rows(R.rejected_searches(searches, "run", "n", "q", "a", "b", 1, 9)) == [("r", 2, "duplicate"), ("r", 3, "outside"), ("r", 4, "outside"), ("r", 5, "outside")]


def test_job_state(spark):
    jobs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "job int")
    attempts = spark.createDataFrame([(1, 1, "accepted"), (1, 2, "failed"), (2, 1, "failed"), (2, 2, None), (3, 1, "failed")], "job int, n int, status string")
    assert rows(R.job_state(jobs, attempts, "job", "n", "status")) == [(1, "done", 2), (2, "interrupted", 2), (3, "failed", 1), (4, "pending", 0)]


def test_frozen_differences_count_repeated_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert rows(R.frozen_differences(a, b, ["x"])) == [(1, "saved"), (2, "rebuilt")]


def test_causal_violations_look_through_inputs(spark):
    asked = spark.createDataFrame([("d", 3)], "node string, cutoff int")
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("d", "a"), ("e", "b")], "src string, dst string")
    assets = spark.createDataFrame([("a", "image", 4), ("b", "report", None), ("c", "image", 3), ("d", "image", None)], "node string, role string, frame int")
    assert rows(R.causal_violations(asked, edges, assets, ["report"])) == [("d", "a", "future_frame"), ("d", "b", "role")]
