"""Provenance operators on worked examples."""

from __future__ import annotations

from caseflow.operators import provenance as P


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_manifests_and_inventories(spark):
    f = spark.createDataFrame([("s", 0, 0.0, 64, 36), ("s", 1, 500.0, 64, 36), ("s", 3, 500.0, 64, 36), ("s", 4, float("nan"), 32, 36)], "source string, frame_index int, timestamp_ms double, width int, height int")
    assert {(r["rule_id"], r["key"]) for r in P.manifest_violations(f, "source").collect()} >= {("ordinal", "3"), ("ordinal", "4"), ("rising", "3"), ("finite", "4"), ("size", "4")}
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("z", "4")], "path string, sha string")
    assert [r["path"] for r in P.asset_conflicts(a, "path", "sha").collect()] == ["z"]
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "5")], "path string, sha string")
    assert rows(P.inventory_diff(a.where("sha != '4'"), b, "path", "sha")) == [("w", "extra"), ("y", "changed"), ("z", "missing")]
    left = spark.createDataFrame([(1, i, str(i)) for i in range(4)] + [(2, 0, "a")], "k int, i int, sha string")
    right = spark.createDataFrame([(1, 0, "0"), (1, 1, "x"), (1, 2, "2"), (2, 0, "a")], "k int, i int, sha string")
    assert rows(P.first_mismatch(left, right, ["k"], "i", "sha")) == [(1, 1)]


def test_exposure_and_releases(spark):
    runs = spark.createDataFrame([("a", 3, False), ("b", 9, True), ("c", 1, False)], "run_id string, frame_index int, outcome boolean")
    seen = P.exposure(runs, spark.createDataFrame([("a", "b"), ("b", None), ("c", "a")], "run_id string, parent_id string"))
    assert rows(seen) == [("a", 9, True), ("b", 9, True), ("c", 9, True)]
    claims = spark.createDataFrame([("k1", "c", 5, True), ("k2", "b", 9, False)], "claim_id string, run_id string, cutoff_index int, causal boolean")
    assert {(r["record_id"], r["rule_id"]) for r in P.exposure_violations(claims, seen).collect()} == {("k1", "future_frame"), ("k1", "outcome")}
    index = P.release_index(spark.createDataFrame([("r2", "k", "test"), ("r1", "k", "train")], "receipt_path string, key string, partition string"))
    assert rows(index) == [("k", "train")] and P.release_conflicts(spark.createDataFrame([("k", "test")], "key string, partition string"), index).count() == 1
    assert rows(P.hidden_assets(spark.createDataFrame([("h",)], "node string"), spark.createDataFrame([("d", "h"), ("e", "d")], "asset_id string, from_id string"))) == [("d", 1), ("e", 2), ("h", 0)]
    turns = spark.createDataFrame([("r", 0, 5), ("r", 1, 4)], "record string, turn int, cutoff_index int")
    cites = spark.createDataFrame([("r", 0, 6), ("r", 1, 2)], "record string, turn int, frame_index int")
    assert {(r["rule_id"], r["key"]) for r in P.turn_violations(turns, cites, "record").collect()} == {("cutoff", "1"), ("future", "6")}
