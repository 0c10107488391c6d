"""Curation requests one after another, and visible sets, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from caseflow.operators import curation as C
from caseflow.operators import turns as T


def requests(spark, rows):
    return spark.createDataFrame(rows, C.REQUEST)


def test_second_edit_of_one_version_is_a_conflict(spark, tmp_path):
    path = f"{tmp_path}/log"
    first = requests(spark, [("r", "f1", "t1", "edit", "one", True, None), ("r", "f1", "t2", "edit", "two", True, None), ("r", "f2", "t1", "delete", None, False, None), ("r", "f2", "t2", "edit", "x", True, "t1"), ("r", "f2", "t3", "restore", None, True, "t1"), ("r", "f2", "t4", "edit", "y", True, "t3")])
    assert {(r["frame_id"], r["at"], r["rule_id"]) for r in C.commit(path, first).collect()} == {("f1", "t2", "conflict"), ("f2", "t2", "deleted")}
    shown = {r["frame_id"]: r for r in C.overlay(C.read(spark, path)).collect()}
    assert (shown["f1"]["text"], shown["f1"]["updated_at"], shown["f1"]["changes"]) == ("one", "t1", 1)
    assert (shown["f2"]["text"], shown["f2"]["deleted"], shown["f2"]["created_at"], shown["f2"]["updated_at"], shown["f2"]["changes"]) == ("y", False, "t1", "t4", 3)
    # the same batch again changes nothing; a refused request may be made anew on the right version
    assert {r["rule_id"] for r in C.commit(path, first).collect()} == {"conflict"}
    assert C.read(spark, path).count() == 4
    later = requests(spark, [("r", "f1", "t9", "delete", None, True, "t1"), ("r", "f1", "t0", "edit", "old", False, None), ("r", "f1", "ta", "edit", "new", False, None), ("r", "f1", "tb", "drop", None, False, None), ("r", "f1", "tc", "restore", "text", False, None), ("r", "f1", "td", "edit", None, False, None), ("r", "f1", "te", "restore", None, False, None), ("r", "f1", "tf", "edit", "a" * 100_001, False, None)])
    assert {r["at"]: r["rule_id"] for r in C.commit(path, later).collect()} == {"t0": "not_later", "ta": "deleted", "tb": "unknown_action", "tc": "text", "td": "text", "tf": "text"}
    shown = C.overlay(C.read(spark, path)).where("frame_id = 'f1'").first()
    assert (shown["text"], shown["deleted"], shown["updated_at"]) == ("one", False, "te")


def test_random_batches(spark, tmp_path):
    rng = random.Random(2)
    rows, clock = [], 0
    for _ in range(300):
        clock += 1
        action = rng.choice(["edit", "edit", "delete", "restore"])
        rows.append(("r", f"f{rng.randrange(6)}", f"{clock:05d}", action, "x" if action == "edit" else None, rng.random() < 0.7, rng.choice([None, f"{max(1, clock - rng.randint(1, 20)):05d}"])))
    versions, deleted, taken = {}, {}, []
    for r in rows:
        key = r[1]
        if (r[5] and r[6] != versions.get(key)) or (r[3] == "edit" and deleted.get(key)):
            continue
        versions[key] = r[2]
        deleted[key] = deleted.get(key, False) if r[3] == "edit" else r[3] == "delete"
        taken.append((key, r[2]))
    for cut in (0, 100, 101, 200):
        end = {0: 100, 100: 101, 101: 200, 200: 300}[cut]
        batch = rows[cut:end]
        rng.shuffle(batch)
        C.commit(f"{tmp_path}/log", requests(spark, batch).repartition(3))
    history = C.read(spark, f"{tmp_path}/log")
    assert sorted((r["frame_id"], r["at"]) for r in history.collect()) == sorted(taken) and len(taken) > 50
    assert {r["frame_id"]: (r["updated_at"], r["deleted"]) for r in C.overlay(history).collect()} == {k: (v, deleted[k]) for k, v in versions.items()}


TURNS = "rec string, turn int, cutoff_index int, causal boolean, mode string"
IMAGES = "rec string, turn int, position int, frame_id string, frame_index int"


def test_rules_of_turns(spark):
    turns = spark.createDataFrame([("a", 0, 5, True, "causal_prefix"), ("a", 1, 4, True, "causal_prefix"), ("a", 2, 9, True, "whole"), ("b", 0, 1, False, "whole")], TURNS)
    images = spark.createDataFrame([("a", 0, 0, "f2", 2), ("a", 0, 1, "f1", 1), ("a", 1, 0, "f5", 5), ("a", 2, 0, "f2", 2), ("a", 2, 1, "gone", None), ("b", 0, 0, "f9", 9)], IMAGES)
    manifest = spark.createDataFrame([("a", 0, "f1"), ("a", 0, "f2"), ("a", 1, "f1"), ("a", 1, "f2"), ("a", 2, "f1"), ("a", 2, "f2"), ("a", 2, "f5"), ("a", 2, "f7"), ("b", 0, "f9")], "rec string, turn int, frame_id string")
    notes = spark.createDataFrame([("a", 0, "n1", "tip", "f5"), ("a", 1, "n1", "tip", "f5"), ("a", 1, "n2", "outcome", None), ("b", 0, "n3", "outcome", None)], "rec string, turn int, annotation_id string, kind string, frame_id string")
    evidence = spark.createDataFrame([("a", 0, "c1", "f1"), ("a", 0, "c2", "f5"), ("a", 1, "c2", "f5")], "rec string, turn int, claim_id string, frame_id string")
    pair = lambda *rows: spark.createDataFrame(list(rows), "rec string, turn int, id string")
    got = T.violations(turns, images, "rec", manifest, notes, evidence, (pair(("a", 0, "c1"), ("a", 0, "c2")), pair(("a", 0, "c1"), ("a", 1, "c2"))), (pair(("a", 0, "r")), pair(("a", 0, "r")))).collect()
    assert sorted((r["record_id"], r["rule_id"], r["key"]) for r in got) == sorted([
        ("a", "cutoff", "1:"), ("a", "image", "2:1"), ("a", "order", "0:1"), ("a", "future", "1:5"), ("a", "mode", "2:"), ("a", "manifest", "1:"), ("a", "manifest", "2:f7"),
        ("a", "outcome", "1:n2"), ("a", "annotation", "0:n1"), ("a", "evidence", "0:c2"), ("a", "claims", "0:c2"), ("a", "claims", "1:c2"),
    ])


def test_manifests_against_sets(spark):
    rng = random.Random(4)
    turns, images, manifest, want = [], [], [], set()
    for rec in "abcdef":
        visible = set()
        for t in range(8):
            turns.append((rec, t, 1000, True, "causal_prefix"))
            for p in range(rng.randint(0, 3)):
                f = rng.randint(0, 12)
                images.append((rec, t, p, f"f{f}", f))
                visible.add(f"f{f}")
            said = set(visible)
            if rng.random() < 0.3:
                said.add(f"f{rng.randint(0, 14)}")
            if rng.random() < 0.3 and said:
                said.discard(rng.choice(sorted(said)))
            manifest += [(rec, t, f) for f in said]
            if said != visible:
                want.add((rec, t))
    got = T.violations(spark.createDataFrame(turns, TURNS), spark.createDataFrame(images, IMAGES), "rec", spark.createDataFrame(manifest, "rec string, turn int, frame_id string"))
    assert {(r["record_id"], int(r["key"].split(":")[0])) for r in got.where(F.col("rule_id") == "manifest").collect()} == want
