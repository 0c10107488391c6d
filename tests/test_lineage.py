"""Runs and the selections that they were made from, against plain sets."""

from __future__ import annotations

import random

from caseflow.operators import lineage as L


def test_sets_are_equal_exactly_if_their_members_are(spark):
    rng = random.Random(8)
    sets = {f"s{k}": {(rng.choice("abc"), rng.choice([1, 2, None])) for _ in range(rng.randint(0, 4))} for k in range(40)}
    rows = [(k, *m) for k, v in sets.items() for m in v for _ in range(rng.randint(1, 3))]
    rng.shuffle(rows)
    left = spark.createDataFrame(rows, "a string, x string, y int").repartition(4)
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets], "a string, b string")
    got = {tuple(r) for r in L.same_sets(left, left.withColumnRenamed("a", "b"), pairs, "a", "b", ["x", "y"]).collect()}
    assert got == {(a, b) for a in sets for b in sets if sets[a] == sets[b]} and len(got) > 60
    one = {r["a"]: r["fingerprint"] for r in L.set_fingerprints(left, "a", ["x", "y"]).collect()}
    assert one == {r["a"]: r["fingerprint"] for r in L.set_fingerprints(left.repartition(1).orderBy("y"), "a", ["x", "y"]).collect()}


def test_run_lineage(spark):
    make = spark.createDataFrame
    runs = make([("ok", "p", "h", "v"), ("free", "p", "h", None), ("gone", "q", "h", None), ("source", "p", "other", None), ("frames", "p", "h", None), ("more", "p", "h", None), ("old", "p", "h", "v0"), ("idle", "p", "h", None), ("wrong", "p", "h", None)], "run string, path string, source_sha256 string, selection_sha256 string")
    selections = make([("p", "h", "v")], "path string, source_sha256 string, sha256 string")
    frames = [(0, "f0"), (1, "f1"), (2, "f2")]
    copies = [(r, *f) for r in ("ok", "free", "source", "old", "idle", "wrong") for f in frames] + [("frames", 0, "f0"), ("frames", 1, "f2"), ("frames", 2, "f1")] + [("more", *f) for f in [*frames, (3, "f3")]]
    targets = [(r, "f1") for r in ("ok", "free", "gone", "source", "frames", "more", "old", "wrong")] + [("wrong", "f0")]
    got = L.run_lineage(runs, selections, make(copies, "run string, i int, frame_id string"), make([("p", *f) for f in frames], "path string, i int, frame_id string"), ["i", "frame_id"], make(targets, "run string, frame_id string"), make([("p", "f1"), ("p", "f2")], "path string, frame_id string"))
    assert {r["run"]: r["rule_id"] for r in got.collect()} == {"ok": None, "free": None, "gone": "unknown_selection", "source": "source", "frames": "frames", "more": "frames", "old": "selection", "idle": "no_target", "wrong": "target"}
