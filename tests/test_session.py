"""A watched case: worked examples, batch against the window detectors, stream against batch, summary."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import detectors as D
from caseflow.operators import log as L
from caseflow.streaming import session as S

BOX = {"x1": 0.4, "y1": 0.4, "x2": 0.6, "y2": 0.6}
DUROTOMY = ("durotomy", "anatomy", 1.0, None, (0.4, 0.4, 0.6, 0.6))
STEPS = (("suturing", "any", ("needle driver",)), ("exposure", "any", ("nerve hook", "grasper")), ("idle", "none", ()))
PROCEDURE = {"steps": STEPS, "transitions": {"idle": ["exposure", "suturing"], "exposure": ["suturing", "idle"], "suturing": ["exposure", "idle"]}, "expected": ("exposure", "suturing")}
ROWS = f"case_id int, {S.ROW}"


def tool(label, x=0.9, y=0.9, confidence=1.0):
    return (label, "instrument", confidence, (x, y), None)


def frame(index, *detections, annotated=True, case=1, t=None):
    return (case, (index - 1) * 1000 if t is None else t, index, annotated, list(detections), None, None)


def asked(t, name, text=None, case=1):
    return (case, t, None, None, None, name, text)


def watched(spark, rows, **settings):
    return S.watch(spark.createDataFrame(rows, ROWS).repartition(3), "case_id", S.Settings(**settings))


def events(spark, rows, *columns, **settings):
    out = watched(spark, rows, **settings).where("record = 'event'").orderBy("event_id").collect()
    return [tuple(r[c] for c in columns or ("type", "subject", "frame_index")) for r in out]


def test_entries_and_exits(spark):
    g = tool("grasper")
    assert events(spark, [frame(1, g), frame(2), frame(3, g), frame(4, g)], "type", "frame_index", "onset_ms", "evidence_frames", enter=2, leave=5) == [("instrument_entered", 4, 2000, [3, 4])]
    assert events(spark, [frame(1, tool("grasper", confidence=0.2))]) == []
    assert events(spark, [frame(1, g), frame(2), frame(3, g), frame(4), frame(5)], "type", "frame_index", "onset_ms") == [("instrument_entered", 1, 0), ("instrument_left", 5, 3000)]
    assert events(spark, [frame(1, g), frame(2, annotated=False), frame(3, annotated=False), frame(7, g)]) == [("instrument_entered", "grasper", 1)]
    assert events(spark, [frame(1, DUROTOMY), frame(2), frame(3)]) == [("anatomy_visible", "durotomy", 1), ("anatomy_hidden", "durotomy", 3)]


def test_near_and_view(spark):
    near, edge, far = tool("needle driver", 0.62, 0.5), tool("needle driver", 0.66, 0.5), tool("needle driver", 0.9, 0.5)
    rows = [frame(1, DUROTOMY, far), frame(2, DUROTOMY, near), frame(3, DUROTOMY, edge), frame(4, DUROTOMY, far)]
    got = events(spark, rows, "type", "frame_index", "object", "data", near=0.05, aspect=1.0)[2:]
    assert got == [("tip_near_structure", 2, "durotomy", {"distance": "0.02"}), ("tip_cleared_structure", 4, "durotomy", {"distance": "0.3"})]
    assert "tip_near_structure" not in {e[0] for e in events(spark, [frame(1, DUROTOMY, tool("grasper", 0.63, 0.5))], near=0.05, aspect=16 / 9)}
    # a run of close frames ends where the structure is gone; leaving ends nearness
    rows = [frame(1, DUROTOMY, near), frame(2, near), frame(3, DUROTOMY, near), frame(4, DUROTOMY, near), frame(5, DUROTOMY), frame(6, DUROTOMY), frame(7, DUROTOMY, near), frame(8, DUROTOMY, near)]
    assert [(e[0], e[2]) for e in events(spark, rows, near=0.05, near_frames=2, leave=2) if "near" in e[0]] == [("tip_near_structure", 4), ("tip_near_structure", 8)]
    g = tool("grasper")
    assert events(spark, [frame(1, g), frame(2), frame(3), frame(4), frame(5), frame(6, g)], "type", "frame_index", "onset_ms", leave=1)[2:] == [("view_empty", 4, 1000), ("instrument_entered", 6, 5000), ("view_restored", 6, 5000)]


def test_steps(spark):
    hook, driver = tool("nerve hook"), tool("needle driver")
    got = events(spark, [frame(i, hook) for i in (1, 2, 3)], "type", "subject", "onset_ms", "cites", "data", **PROCEDURE)
    assert got[1:] == [("step_changed", "exposure", 0, ["E000001"], {"from": "idle"})]
    got = events(spark, [frame(i, driver) for i in (1, 2, 3)], "type", "cites", "data", **PROCEDURE)
    assert [g[0] for g in got] == ["instrument_entered", "step_changed", "step_unexpected"] and got[2][1] == ["E000002"] and got[2][2]["reason"] == "suturing began before exposure was observed"
    got = events(spark, [*(frame(i, hook) for i in (1, 2, 3)), frame(4, driver), frame(5, hook), frame(6, hook)], **PROCEDURE)
    assert [g[:2] for g in got if g[0] == "step_changed"] == [("step_changed", "exposure")]


RULES = (
    {"id": "lost", "type": "instrument_left", "subject": "needle", "present": ["needle driver"], "priority": "critical", "cooldown_ms": 10_000, "message": "needle left while {step}."},
    {"id": "close", "type": "tip_near_structure", "object": "durotomy", "priority": "high", "message": "{subject} is close to {what}, {distance}."},
    {"id": "alone", "type": "instrument_entered", "absent": ["needle"], "step": "suturing", "priority": "low", "message": "{{subject}}"},
)


def test_alerts_and_gate(spark):
    driver, needle = tool("needle driver", 0.62, 0.5), tool("needle")
    rows = [frame(1, DUROTOMY, driver, needle), frame(2, driver, needle), frame(3, driver), frame(4, driver), frame(5, driver, needle), frame(6, driver), frame(7, driver), asked(3500, "Q2", "yes"), asked(0, "Q1"), asked(99_000, "Q9")]
    out = watched(spark, rows, near=0.05, aspect=1.0, rules=RULES, **PROCEDURE).collect()
    alerts = [(r["event_id"], r["subject"], r["object"], r["cites"], r["data"]["message"]) for r in out if r["type"] == "alert"]
    assert alerts == [
        ("E000005", "close", "needle driver", ["E000004"], "Needle driver is close to unknown, 0.02."),
        ("E000010", "lost", "needle", ["E000009", "E000003"], "Needle left while suturing."),
        ("E000013", "lost", "needle", ["E000012", "E000003"], "Needle left while suturing."),
    ]
    said = [(r["t_ms"], r["key"], r["reason"], r["cites"]) for r in out if r["record"] == "utterance"]
    assert said == [(0, "rule:close:needle driver", "spoken", ["E000005", "E000004"]), (3000, "rule:lost:needle", "spoken", ["E000010", "E000009", "E000003"]), (4000, "answer:Q2", "answer", None), (6000, "rule:lost:needle", "cooldown", ["E000013", "E000012", "E000003"])]
    assert [(r["question_id"], r["scheduled_ms"], r["t_ms"], r["frame_index"]) for r in out if r["record"] == "asked"] == [("Q1", 0, 0, 1), ("Q2", 3500, 4000, 5)]
    # the budget of a minute holds for all but critical ones
    rows = [frame(1 + 2 * i, tool(f"t{i}"), t=i * 1000) for i in range(8)] + [frame(99, tool("late one"), t=60_001)]
    rule = {"id": "in", "type": "instrument_entered", "priority": "low", "message": "m"}
    reasons = [r["reason"] for r in watched(spark, rows, rules=(rule,), per_minute=3, leave=100).where("record = 'utterance'").orderBy("t_ms").collect()]
    assert reasons == ["spoken"] * 3 + ["rate_limited"] * 5 + ["spoken"]
    assert {r["reason"] for r in watched(spark, rows, rules=(rule | {"priority": "critical"},), per_minute=3).where("record = 'utterance'").collect()} == {"spoken"}
    weak = [frame(1, tool("x", confidence=0.55))]
    assert [r["reason"] for r in watched(spark, weak, rules=(rule,), speak_least=0.6).where("record = 'utterance'").collect()] == ["low_confidence"]


def test_messages():
    assert S.said("{a} and {b}{c}", {"a": "{b}", "b": ""}) == "{b} and unknown"
    assert S.said("", {}) == "" and S.said("no field", {}) == "No field"


def test_late_frames_and_gaps(spark):
    rows = [frame(1, tool("a")), frame(2, t=None, annotated=False), frame(3, t=100_000), frame(4, t=100_000), (1, None, 5, True, [], None, None), frame(1, case=2, t=0), asked(5, "alone", case=3)]
    out = watched(spark, rows).collect()
    assert [(r["case_id"], r["t_ms"]) for r in out if r["record"] == "closed"] == [(1, 1000)]
    assert [(r["frame_index"], r["t_ms"]) for r in out if r["record"] == "late"] == [(5, None)]
    assert watched(spark, []).collect() == []


def sample(seed=4, cases=4, n=60):
    rng = random.Random(seed)
    rows = []
    for case in range(cases):
        for i in range(1, n + 1):
            seen = [tool(x, 0.35 + 0.4 * rng.random(), 0.35 + 0.4 * rng.random(), rng.choice([0.3, 0.8, 1.0])) for x in ("needle driver", "nerve hook", "needle") if rng.random() < 0.45]
            if rng.random() < 0.7:
                seen.append(DUROTOMY)
            if rng.random() < 0.25:
                seen = []
            rows.append((case, i * 1000 + (70_000 if i > 40 else 0), i, rng.random() < 0.9, seen, None, None))
        rows += [asked(rng.randint(0, 120_000), f"Q{k}", rng.choice([None, "text"]), case) for k in range(5)]
    return rows


FULL = {"near": 0.05, "near_frames": 1, "enter": 2, "rules": RULES, **PROCEDURE}


def test_batch_equals_the_window_detectors(spark):
    rows = spark.createDataFrame(sample(), ROWS)
    log = S.watch(rows, "case_id", S.Settings(**FULL)).where("record = 'event'").cache()
    seen = rows.where("annotated and question_id is null").withColumn("seen", F.filter("detections", lambda d: d["confidence"] >= 0.5)).withColumn("labels", F.transform("seen", lambda d: d["label"]))
    flat = lambda df, *c: {tuple(r) for r in df.select("case_id", *c).collect()}
    entries = D.hysteresis(D.presence(seen, "case_id", "frame_index", "t_ms", "labels"), "case_id", "frame_index", "t_ms", 2, 2)
    mine = log.where("type in ('instrument_entered', 'instrument_left', 'anatomy_visible', 'anatomy_hidden')").withColumn("type", F.when(F.col("type").isin("instrument_entered", "anatomy_visible"), "entered").otherwise("left"))
    assert flat(mine, "subject", "type", "frame_index", "t_ms", "onset_ms") == flat(entries, "label", "type", "frame_index", "t_ms", "onset_ms") and mine.count() > 50
    views = D.view_runs(seen, "case_id", "frame_index", "t_ms", F.size("labels") > 0, 3)
    assert flat(log.where("subject = 'view'"), "type", "frame_index", "onset_ms") == flat(views, "type", "frame_index", "onset_ms")
    assert log.where("type like 'tip%'").count() > 5 and log.where("type = 'step_changed'").count() > 3


def test_stream_equals_batch(spark, tmp_path):
    rows = sample(8)
    L.with_state_store(spark)
    os.makedirs(tmp_path / "in")
    ordered = sorted(rows, key=lambda r: (r[1], r[5] is None))
    cuts = [0, 70, 71, 150, len(ordered)]
    for k in range(4):
        df = spark.createDataFrame(ordered[cuts[k] : cuts[k + 1]], ROWS).withColumn("at", F.timestamp_millis("t_ms"))
        df.coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (name,) = [f for f in os.listdir(tmp_path / f"w{k}") if f.endswith(".parquet")]
        os.rename(tmp_path / f"w{k}" / name, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema(f"{ROWS}, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    S.split(S.watch_stream(stream, "case_id", S.Settings(**FULL)), f"{tmp_path}/c", f"{tmp_path}/out")
    key = lambda r: tuple(str(r[c]) for c in ("case_id", *S._NAMES))
    got = sorted(map(key, spark.read.parquet(f"{tmp_path}/out").where("record != 'closed'").collect()))
    want = S.watch(spark.createDataFrame(rows, ROWS), "case_id", S.Settings(**FULL))
    assert got == sorted(map(key, want.where("record != 'closed'").collect())) and len(got) > 150
    closed = lambda df: sorted((r["case_id"], r["t_ms"]) for r in df.where("record = 'closed'").collect())
    assert closed(spark.read.parquet(f"{tmp_path}/out")) == closed(want) == [(c, 40_000) for c in range(4)]


def test_perception_join(spark):
    frames = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "case_id int, frame_index long")
    labels = spark.createDataFrame([(1, 1, "b", "instrument", 1.0, (0.1, 0.2), None), (1, 1, "a", "anatomy", 1.0, None, (0.0, 0.0, 1.0, 1.0)), (1, 2, None, None, None, None, None)], "case_id int, frame_index long, label string, kind string, confidence double, tip struct<x:double,y:double>, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = {r["frame_index"]: (r["annotated"], r["detections"] and [d["label"] for d in r["detections"]]) for r in S.observed(frames, labels, "case_id", "frame_index").collect()}
    assert got == {1: (True, ["a", "b"]), 2: (True, []), 3: (False, None)}


def test_summary(spark):
    rows = [frame(1, DUROTOMY, tool("needle driver", 0.62, 0.5)), frame(2, tool("needle driver")), asked(0, "Q1", "yes"), asked(0, "Q2")]
    out = watched(spark, rows, near=0.05, aspect=1.0, rules=RULES).cache()
    answers = spark.createDataFrame([(1, "Q1", "answered", True, 120.0, 0.0), (1, "Q3", None, None, None, None)], "case_id int, question_id string, status string, supported boolean, elapsed_ms double, staleness_ms double")
    timings = spark.createDataFrame([(1, "total", float(x)) for x in (10, 20, 30, 1001)] + [(1, "gate", 0.5)], "case_id int, stage string, ms double")
    got = {r["part"]: r["value"] for r in S.summary(out, "case_id", answers, timings, 1000.0).collect()}
    assert got == {
        "events.anatomy_visible": 1, "events.instrument_entered": 1, "events.tip_near_structure": 1, "events.alert": 1, "utterances.by_reason.spoken": 1, "utterances.by_reason.answer": 1, "utterances.spoken": 2,
        "questions.by_status.answered": 1, "questions.by_status.agent_unavailable": 1, "questions.asked": 2, "questions.supported": 1, "questions.not_asked": 1, "frames": 4, "missed_deadlines": 1,
        "timing.total.count": 4, "timing.total.p50": 30, "timing.total.p95": 1001, "timing.total.max": 1001, "timing.total.mean": 265.25, "timing.gate.count": 1, "timing.gate.p50": 0.5, "timing.gate.p95": 0.5, "timing.gate.max": 0.5, "timing.gate.mean": 0.5,
        "questions.elapsed_ms.count": 1, "questions.elapsed_ms.p50": 120, "questions.elapsed_ms.p95": 120, "questions.elapsed_ms.max": 120, "questions.elapsed_ms.mean": 120,
        "questions.staleness_ms.count": 1, "questions.staleness_ms.p50": 0, "questions.staleness_ms.p95": 0, "questions.staleness_ms.max": 0, "questions.staleness_ms.mean": 0,
    }


@pytest.mark.parametrize("settings", [{}, {"steps": STEPS}])
def test_questions_alone_have_no_rows(spark, settings):
    assert watched(spark, [asked(1, "Q")], **settings).collect() == []
