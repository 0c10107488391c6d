"""Question templates, grading, claim rules, citations and curation on worked examples."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from caseflow.functions import text as X
from caseflow.operators import annotations as A
from caseflow.operators import detectors as D
from caseflow.operators import evaluate as V

#: Labels in view by frame (1 a second), and frames in which the driver is near.
TIMELINE = {"durotomy": range(1, 12), "nerve hook": range(2, 5), "needle driver": range(5, 12), "needle": [5, 6, 7, 8, 11]}


def log(spark):
    rows = [(1, i, (i - 1) * 1000, sorted(k for k, v in TIMELINE.items() if i in v)) for i in range(1, 13)]
    obs = spark.createDataFrame(rows, "case_id int, frame_index int, t_ms long, labels array<string>")
    ev = D.hysteresis(D.presence(obs, "case_id", "frame_index", "t_ms", "labels"), "case_id", "frame_index", "t_ms", 1, 2)
    ev = ev.select("case_id", "label", "type", "t_ms", "onset_ms", (F.col("frame_index") * 10).cast("long").alias("seq"))
    near = spark.createDataFrame([(1, "needle driver", "near", 6000, 6000, 71)], "case_id int, label string, type string, t_ms long, onset_ms long, seq long")
    return ev.unionByName(near)


def test_question_templates(spark):
    asked = [
        ("visible_now", None, 6000, ["durotomy", "needle", "needle driver"]), ("first_seen", "needle driver", 6000, 4.0), ("first_seen", "grasper", 6000, None), ("entry_count", "needle", 11_000, 2),
        ("near_now", None, 6000, True), ("near_now", None, 1000, False), ("time_in_view", "needle driver", 6000, 2.0), ("time_in_view", "nerve hook", 6000, 0.0), ("last_left", "nerve hook", 6000, 4.0), ("last_left", "needle driver", 6000, None),
    ]
    q = spark.createDataFrame([(1, f"Q{i:03d}", *a[:3]) for i, a in enumerate(asked)], "case_id int, question_id string, template string, label string, at_ms long")
    truth = V.answers(q, log(spark))
    got = {r["question_id"]: None if r["answer"] is None else json.loads(r["answer"]) for r in truth.collect()}
    assert [got[f"Q{i:03d}"] for i in range(len(asked))] == [a[3] for a in asked]
    assert {r["status"] for r in V.grade(truth, truth).collect()} == {"right"}
    loose = spark.createDataFrame([(1, "Q000", '["Needle ","durotomy","needle driver"]'), (1, "Q001", "about 4.5 seconds"), (1, "Q004", "no"), (1, "Q007", "9 s")], "case_id int, question_id string, answer string")
    status = {r["question_id"]: r["status"] for r in V.grade(truth, loose).collect()}
    assert [status[f"Q00{i}"] for i in (0, 1, 2, 4, 7)] == ["right", "right", "missing", "wrong", "wrong"]


def test_view_labels_and_claim_rules(spark):
    views = spark.createDataFrame([("p", 5, f, i, r) for i, (f, r) in enumerate([(5, "full"), (5, "crop"), (5, "crop"), (4, "full"), (3, "full"), (6, "full")])], "packet string, target int, frame int, n int, role string")
    got = {r["n"]: r["view_label"] for r in A.view_labels(views, "packet", "target", "frame", "n", "role").collect()}
    assert got == {0: "T", 1: "T1", 2: "T2", 3: "B2", 4: "B1", 5: "A1"}
    packets = spark.createDataFrame([("p", ["T"], ["B1"], {"T": 5, "B1": 4}, True, 0)], "packet string, target_views array<string>, context_views array<string>, frames_of map<string,int>, poor boolean, questions long")
    claims = [("c1", "object", "visible", None, ["T"]), ("c2", "object", "visible", None, ["T", "B1"]), ("c3", "action", "inferred", None, ["T"]), ("c4", "step", "inferred", " ", ["T"]), ("c5", "object", "inferred", None, ["B1", "Z"]), ("c1", "object", "visible", None, ["T"])]
    df = spark.createDataFrame([("p", c, k, s, u, v, f"says {c}") for c, k, s, u, v in claims], "packet string, claim_id string, category string, support string, uncertainty string, views array<string>, statement string")
    assert sorted((r["rule_id"], r["key"]) for r in A.claim_violations(df, packets, "packet").collect()) == [("action", "c3"), ("poor_question", ""), ("step", "c4"), ("target", "c5"), ("unique_claim", "c1"), ("unknown_view", "c5"), ("visible", "c2")]
    assert A.captions(df.where("claim_id in ('c2', 'c3')"), "packet").first()[1:] == ("says c2", "says c3")


def test_citations_and_curation(spark):
    events = spark.createDataFrame([(1, "E1", 1000, "needle", None), (1, "E2", 9000, "hook", None)], "case_id int, event_id string, t_ms long, subject string, object string")
    claims = spark.createDataFrame([(1, "a", ["E1"], 5000, "the needle"), (1, "b", ["E2"], 5000, "the hook"), (1, "c", [], 5000, "x"), (1, "d", ["E9", "E1"], 5000, "the hook")], "case_id int, claim_id string, cites array<string>, now_ms long, text string")
    got = {r["claim_id"]: r["reasons"] for r in A.citation_verdicts(claims, events, "now_ms", X.mentions(F.col("text"), ["needle", "hook"])).collect()}
    assert got == {"a": [], "b": ["future"], "c": ["no_citation"], "d": ["unknown", "wrong_subject"]}
    current = spark.createDataFrame([("r", "f1", 10, False)], "review_identity string, frame_id string, updated_at long, deleted boolean")
    changes = spark.createDataFrame([("r", "f1", 20, False, 10), ("r", "f2", 21, False, None), ("r", "f1", 22, True, 9)], "review_identity string, frame_id string, updated_at long, deleted boolean, expected long")
    new, conflicts = A.upsert_curation(current, changes)
    assert sorted((r["frame_id"], r["updated_at"]) for r in new.collect()) == [("f1", 20), ("f2", 21)] and conflicts.count() == 1
    notes = spark.createDataFrame([("r", f, s, c, u) for f, s, c, u in [("f1", "reviewed", False, 20), ("f2", "reviewed", False, 20), ("f1", "draft", False, 20), ("f1", "reviewed", True, 20)]], "review_identity string, frame_id string, status string, needs_recheck boolean, curation_updated_at long")
    assert A.approved(notes, new).count() == 1
    frames = spark.createDataFrame([("a",), ("a",), ("b",)], "image_sha256 string")
    cache = spark.createDataFrame([("a", "e1", [1.0]), ("b", "e2", [2.0])], "image_sha256 string, fingerprint string, embedding array<double>")
    assert [r[0] for r in A.encode_misses(frames, cache, "e1").collect()] == ["b"] and A.with_embeddings(frames, cache, "e1").where("embedding is null").count() == 1
