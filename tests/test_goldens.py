"""Worked examples with known answers, for the operators by themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.functions import text as X
from caseflow.operators import contracts as K
from caseflow.operators import detectors as D
from caseflow.operators import events as E
from caseflow.operators import exports as EX
from caseflow.operators import graph as G
from caseflow.operators import intervals as IV
from caseflow.operators import metrics as M
from caseflow.operators import selection as S
from caseflow.operators import timeline as TL
from caseflow.sources import tables as SRC


def seen(spark, present):
    return spark.createDataFrame([(1, i, (i - 1) * 1000, "needle", bool(p)) for i, p in present], "case_id int, frame_index int, t_ms long, label string, present boolean")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hysteresis_onsets(spark):
    got = D.hysteresis(seen(spark, [(1, 1), (2, 0), (3, 1), (4, 1)]), "case_id", "frame_index", "t_ms", 2, 2)
    assert rows(got.select("type", "frame_index", "onset_ms")) == [("entered", 4, 2000)]
    got = D.hysteresis(seen(spark, [(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)]), "case_id", "frame_index", "t_ms", 1, 2)
    assert rows(got.select("type", "frame_index", "onset_ms")) == [("entered", 1, 0), ("left", 5, 3000)]
    # rows that were not annotated are not there, so they end nothing
    got = D.hysteresis(seen(spark, [(1, 1), (4, 1)]), "case_id", "frame_index", "t_ms", 1, 2)
    assert rows(got.select("type", "frame_index")) == [("entered", 1)]


def test_view_and_proximity(spark):
    obs = spark.createDataFrame([(1, i, (i - 1) * 1000, i in (1, 5)) for i in range(1, 6)], "case_id int, frame_index int, t_ms long, any boolean")
    got = D.view_runs(obs, "case_id", "frame_index", "t_ms", F.col("any"), 3)
    assert rows(got.select("frame_index", "type", "onset_ms")) == [(4, "view_empty", 1000), (5, "view_restored", 4000)]
    near = spark.createDataFrame([(1, i, (i - 1) * 1000, True, True, d) for i, d in enumerate([0.2, 0.02, 0.06, 0.2], 1)], "case_id int, frame_index int, t_ms long, instrument boolean, structure boolean, distance double")
    got = D.proximity(near, ["case_id"], "frame_index", "t_ms", 0.05, 1.5, 1)
    assert rows(got.select("frame_index", "type")) == [(2, "near"), (4, "clear")]


def test_dwell_and_transitions(spark):
    steps = ["a", "a", "a", None, "c", "c", "c", "a", "b", "b", "b"]
    df = spark.createDataFrame([(1, i, i * 1000, s) for i, s in enumerate(steps)], "case_id int, frame_index int, t_ms long, candidate string")
    got = D.step_checks(D.dwell(df, "case_id", "frame_index", "t_ms", "candidate", 3, "idle"), "case_id", "frame_index", {"idle": ["a"], "a": ["b"], "b": ["c"]}, ["a", "b", "c"], "idle")
    assert rows(got.select("frame_index", "step", "from_step", "legal", "skipped")) == [(2, "a", "idle", True, False), (6, "c", "a", False, True), (10, "b", "c", False, False)]


def test_gate_decisions(spark):
    def decide(items, **o):
        o = {"stale": 3000, "least": 0.6, "cooldown": 10_000, "minute": 100} | o
        df = spark.createDataFrame([(1, i, now - age, now, key, prio, conf, ans) for i, (now, age, key, prio, conf, ans) in enumerate(items)], "case_id int, n int, t_ms long, now_ms long, key string, priority string, confidence double, is_answer boolean")
        return [r["decision"] for r in E.gate(df, "case_id", ["n"], o["stale"], o["least"], o["cooldown"], o["minute"]).orderBy("n").collect()]

    assert decide([(0, 0, "k", "notice", 1.0, False), (5000, 0, "k", "notice", 1.0, False), (10_000, 0, "k", "notice", 1.0, False)]) == ["spoken", "cooldown", "spoken"]
    many = [(i * 10, 0, f"k{i}", "critical" if i == 3 else "notice", 1.0, False) for i in range(4)] + [(60_030, 0, "k9", "notice", 1.0, False)]
    assert decide(many, minute=2) == ["spoken", "spoken", "rate_limited", "spoken", "spoken"]
    assert decide([(4000, 4000, "k", "notice", 1.0, False), (4000, 0, "k", "notice", 0.5, False), (9000, 9000, "k", "notice", 0.1, True)]) == ["stale", "low_confidence", "spoken"]


def test_event_queries(spark):
    log = spark.createDataFrame([(1, f"E{i:06d}", i * 1000, t, s, None) for i, (t, s) in enumerate([("entered", "needle"), ("entered", "hook"), ("left", "hook"), ("entered", "hook")], 1)], "case_id int, event_id string, t_ms long, type string, subject string, object string")
    ask = lambda **o: [r["event_id"] for r in E.causal_query(log, "case_id", F.lit(3500), **o).orderBy("event_id").collect()]
    assert ask() == ["E000001", "E000002", "E000003"]
    assert ask(types=["entered"], limit=1) == ["E000002"] and ask(subject="needle") == ["E000001"] and ask(since=F.lit(2000), until=F.lit(2500)) == ["E000002"]
    state = lambda now: {r["subject"] for r in E.state_at(log, ["case_id", "subject"], F.lit(now), "event_id", "entered").collect()}
    assert state(2500) == {"needle", "hook"} and state(3500) == {"needle"} and state(500) == set()


def test_even_spacing_and_rationals(spark):
    f = spark.createDataFrame([(1, i, i * 1000) for i in range(1, 12)], "case_id int, frame_index int, t_ms long")
    take = lambda k: [r["frame_index"] for r in TL.evenly_spaced(f, "case_id", F.lit(1000), F.lit(11_000), k).orderBy("frame_index").collect()]
    assert take(3) == [1, 6, 11] and take(1) == [6] and take(20) == list(range(1, 12)) and take(4) == [1, 4, 8, 11]
    decoded = spark.createDataFrame([(1, i, (i - 1) * 500 + 1000, 1, 1000) for i in range(1, 5)] + [(2, i, (i - 1) * 500 + (300 if i == 3 else 0), 1, 1000) for i in range(1, 5)], "case_id int, frame_index int, pts long, tb_num long, tb_den long")
    assert [(r["case_id"], r["within"]) for r in TL.nominal_deviation(decoded, "case_id", 2, 1).orderBy("case_id").collect()] == [(1, True), (2, False)]


def test_selection_prefers_local_change_and_clarity():
    t = np.arange(12) * 1000.0
    same = np.tile(np.array([1.0, 0, 0]), (12, 1))
    regions = np.stack([same, same], 1)
    regions[5, 1] = [0, 1, 0]
    assert S.choose(t, same, regions, np.full(12, 0.5), 3)[1] == [0, 5, 11]
    clear = np.full(8, 0.3)
    clear[3] = 1
    assert S.choose(t[:8], same[:8], same[:8, None], clear, 3)[1] == [0, 3, 7]
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    protected, chosen = S.choose(np.arange(120) * 1000.0, v, rng.normal(size=(120, 9, 8)), S.midranks(rng.random(120)), 24)
    assert len(protected) == 8 and [sum(lo <= c < lo + 30 for c in chosen) for lo in (0, 30, 60, 90)] == [6, 6, 6, 6]


@pytest.mark.parametrize(("n", "want"), [(24, [0, 12, 17, 22]), (5, [0, 3, 4, 4]), (2, [0, 1, 1, 1])])
def test_cohort_sizes(spark, n, want):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, n + 1)], "c int, rank int, item int")
    got = S.cohorts(ranked, "c", "rank", "item", [50, 70, 90, 0]).orderBy("percent").collect()
    assert [r["withheld"] for r in got] == want


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 10_000), (1, 9_200, 13_000)], "c int, a long, b long")
    assert rows(IV.union_length(spans, ["c"], "a", "b")) == [(1, 13_800, 13_000)]
    frames = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([1000, 1400, 5000, 2500])], "c int, frame_id int, t double")
    anchors = spark.createDataFrame([(1, 7, 1000.0), (1, 8, 3000.0), (1, 9, 2200.0)], "c int, moment int, anchor double")
    got = {r["frame_id"]: (r["match_kind"], r["moment"]) for r in IV.anchor_matches(frames, anchors, ["c"], "t", "anchor", "moment", 500.0).collect()}
    assert got == {0: ("exact", 7), 1: ("single", 7), 2: ("outside", None), 3: ("ambiguous", None)}
    x = spark.createDataFrame([(1, 0, 5), (1, 20, 25)], "c int, a int, b int")
    y = spark.createDataFrame([(1, 5, 19), (1, 100, 90)], "c int, s int, e int")
    assert rows(IV.overlap_join(x, y, ["c"], ("a", "b"), ("s", "e"), 7).select("a", "s")) == [(0, 5)]


def test_queue_order(spark):
    data = [("S1A1", "better"), ("S1A2", "better"), ("S1A10", "better"), ("S2A1", "worse"), ("S3A1", "worse"), ("Clip0", "unknown"), ("Clip1", "unknown")]
    df = spark.createDataFrame([("q", *d) for d in data], "q string, case_id string, outcome string")
    got = S.interleave(df, "outcome", "unknown", [S.natural_key(F.col("case_id"))], ["q"]).orderBy("queue_position").collect()
    assert [r["case_id"] for r in got] == ["S1A1", "S2A1", "S1A2", "S3A1", "S1A10", "Clip0", "Clip1"]


def test_round_robin_gives_an_item_once(spark):
    df = spark.createDataFrame([("p", r, o, i) for r, o, i in [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c")]], "p string, r int, o int, item string")
    got = S.round_robin(df, ["p"], "r", ["o"], "item", 2).orderBy("place").collect()
    # the second request's first item is taken: it goes on to its next in the same turn
    assert [r["item"] for r in got] == ["a", "c"]
    known = spark.createDataFrame([("p", "a")], "p string, item string")
    got = S.round_robin(df, ["p"], "r", ["o"], "item", 5, known).orderBy("place").collect()
    assert [(r["item"], r["r"], r["turn"]) for r in got] == [("b", 1, 1), ("c", 2, 1)]


def test_selection_against_its_definition():
    """Greedy choice, one frame at a time and one distance at a time, on 40 frames of 9 regions."""
    rng = np.random.default_rng(3)
    n, budget = 40, 13
    t, v, regions, clarity = np.cumsum(rng.integers(1, 900, n)).astype(float), rng.normal(size=(n, 6)), rng.normal(size=(n, 9, 6)), S.midranks(rng.random(n))
    cos = lambda a, b: min(2.0, max(0.0, 1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b))))
    part = lambda i, j: max(cos(regions[i, k], regions[j, k]) for k in range(9))
    chosen = {0, n - 1}
    for goal in np.linspace(t[0], t[-1], 5)[1:-1]:
        chosen.add(min((abs(t[i] - goal), i) for i in range(n) if i not in chosen)[1])
    bin_of = [min(3, int((x - t[0]) / (t[-1] - t[0]) * 4)) for x in t]
    while len(chosen) < budget:
        filled = [sum(bin_of[j] == b for j in chosen) for b in range(4)]
        free = [i for i in range(n) if i not in chosen]
        least = min(filled[bin_of[i]] for i in free)
        points = lambda i: 0.5 * min(cos(v[i], v[j]) for j in chosen) + 0.3 * min(part(i, j) for j in chosen) + 0.15 * (max(cos(v[i], v[i - 1]), part(i, i - 1)) if i else 0) + 0.05 * clarity[i]  # noqa: B023, E731
        chosen.add(max((i for i in free if filled[bin_of[i]] == least), key=lambda i: (round(points(i), 12), -i)))
    assert S.choose(t, v, regions, clarity, budget)[1] == sorted(chosen)


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", None)], "k string, v double")
    got = {r["k"]: r for r in M.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (got["a"]["n"], got["a"]["p50"], got["a"]["p95"], got["a"]["mean"]) == (5, 3.0, 100.0, 22.0) and "b" not in got
    none = spark.createDataFrame([(False, False)], "p boolean, a boolean")
    assert M.confusion(none, [], F.col("p"), F.col("a")).first()["f1"] is None
    box = lambda a, b, c, d: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (a, b, c, d), strict=True)])
    r = spark.range(1).select(M.iou(box(0, 0, 1, 1), box(0.5, 0, 1.5, 1)).alias("i"), M.point_to_box(F.lit(2.0), F.lit(0.5), box(0, 0, 1, 1), 2.0).alias("d"), M.crop(box(0, 0, 0.5, 0.5), box(0.25, 0.25, 0.75, 0.75)).alias("c")).first()
    assert round(r["i"], 6) == round(1 / 3, 6) and r["d"] == 2.0 and tuple(r["c"]) == (0.0, 0.0, 0.5, 0.5)


def test_contracts(spark):
    m = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "x"), (2, 2, "user", " "), (3, 0, "user", "q"), (3, 1, "system", "s")]
    bad = K.message_rules(spark.createDataFrame(m, "c int, turn int, role string, text string"), "c", "turn", "role", "text")
    assert {(r["record_id"], r["rule_id"]) for r in bad.collect()} == {("2", "start"), ("2", "turn_gap"), ("2", "end"), ("2", "empty"), ("3", "system_late"), ("3", "end")}
    with pytest.raises(ValueError, match="2"):
        K.require(bad)
    K.require(bad.limit(0))
    leak = K.leakage(spark.createDataFrame([("train", "p1", "h1"), ("test", "p1", "h2"), ("test", None, "h2")], "part string, patient string, image string"), ["patient", "image"], "part")
    assert rows(leak) == [("patient", "p1", "test,train")]
    texts = spark.createDataFrame([(1, "a😀bc d")], "k int, text string")
    claims = spark.createDataFrame([(1, 1, 3, "😀b"), (1, 0, 2, "ab"), (9, 0, 1, "a")], "k int, start int, end int, quote string")
    assert rows(K.span_mismatches(claims, texts, "k").select("k", "quote")) == [(1, "ab"), (9, "a")]
    assert K.uncovered(claims.where("k = 1 and quote = '😀b'"), texts, "k").first()["uncovered"] == 3


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert rows(G.on_cycles(e)) == [("x", "y"), ("y", "x")]
    assert rows(G.closure(e.where("src in ('a', 'b')"))) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(G.reachable(spark.createDataFrame([("x",)], "node string"), e)) == [("x", 0), ("y", 1), ("z", 2)]


def test_text_functions(spark):
    r = spark.createDataFrame([("  Needle   Driver TIP ", "the needle driver and a needle", "about 4.5 seconds", " YES ", "<a href=\"x\">'&'</a>", 61_005)], "a string, b string, c string, d string, e string, ms long")
    got = r.select(X.label(F.col("a"), ["tip", "base"]).alias("l"), X.mentions(F.col("b"), ["needle", "needle driver", "grasper"]).alias("m"), X.number(F.col("c")).alias("n"), X.boolean(F.col("d")).alias("y"), X.html_escape(F.col("e")).alias("h"), X.clock(F.col("ms")).alias("t"), X.similarity("b", "b").alias("s")).first()
    assert tuple(got["l"]) == ("needle driver", "tip") and got["m"] == ["needle", "needle driver"] and got["n"] == 4.5 and got["y"] is True
    assert got["h"] == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;" and got["t"] == "01:01.005" and got["s"] == 1.0
    paths = spark.createDataFrame([("a/b.png",), ("/a",), ("a/../b",), ("c:x",), ("",), ("a//b",)], "p string")
    assert [r["s"] for r in paths.select(X.safe_path(F.col("p")).alias("s")).collect()] == [True, False, False, False, False, False]


def test_csv_lines_and_strictness(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "t.csv").write_bytes("﻿id,note\n1,\"two\nlines\"\n2,x\n".encode())
    got = SRC.csv_with_lines(spark, str(good), ["id", "note"]).select("ordinal", "line", "id", "note")
    assert rows(got) == [(2, 3, "1", "two\nlines"), (3, 4, "2", "x")]
    (good / "t.csv").write_text("id,note\n1\n")
    with pytest.raises(Exception, match="fields"):
        SRC.csv_with_lines(spark, str(good), ["id", "note"]).collect()
    j = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("{",)], "j string")
    assert [r["ok"] for r in j.select(SRC.strict_json(F.col("j")).isNotNull().alias("ok")).collect()] == [True, False, False]


def test_sources(spark):
    files = spark.createDataFrame([("/x/S1A1_frame_00000001.jpeg",), ("/x/S1A1_frame_00000003.jpeg",), ("/x/readme.txt",)], "path string")
    frames = SRC.frame_files(files)
    assert rows(frames.select("case_id", "frame_index", "t_ms")) == [("S1A1", 1, 0), ("S1A1", 3, 2000)]
    assert rows(SRC.release_violations(frames)) == [("S1A1", "gap")]
    o = spark.createDataFrame([("A", "Y", "50"), ("A", "N", ""), ("B", "maybe", "-1"), ("C", "", "nan")], "id string, leak string, time string")
    assert rows(SRC.outcome_violations(o, "id", "leak", ["time"])) == [("A", "repeated key"), ("A", "repeated key"), ("B", "leak"), ("B", "time"), ("C", "time")]
    p = spark.createDataFrame([("f1", "needle", "55", "5", "55", "5"), ("f1", "needle", "55", "5", "55", "5"), ("f2", " ", "1", "1", "1", "1")], "trial_frame string, label string, x1 string, y1 string, x2 string, y2 string")
    b = spark.createDataFrame([("f1", "dura", "40", "26", "20", "-10")], p.schema)
    odd = SRC.label_rows(spark.createDataFrame([("f3", "x", "n/a", "1", "1", "1"), ("f4", "x", "nan", "1", "1", "1"), ("f5", "x", None, "1", "1", "1"), ("f6", "x", "-5", "99", "1", "1")], p.schema), b.limit(0), 64, 36)
    assert {(r["trial_frame"], r["kind"], r["x1"], r["y2"]) for r in odd.collect()} == {("f3", None, None, None), ("f4", None, None, None), ("f5", None, None, None), ("f6", "box", 0.0, 1.0)}
    got = SRC.label_rows(p, b, 64, 36)
    assert got.count() == 3 and got.where("kind = 'box'").first()["x1"] == 20 / 64 and got.where("kind = 'box'").first()["y1"] == 0.0 and got.where("label is null").count() == 1


def test_export_round_trip_and_tampering(spark, tmp_path):
    m = spark.createDataFrame([(i, t, r, f"text {i} {t}") for i in range(3) for t, r in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    rows_ = EX.message_rows(m, "conv_id", "turn", "role", "text")
    assert [r["p"] for r in rows_.select(EX.portable(F.col("messages")).alias("p")).collect()] == [True] * 3
    at = str(tmp_path / "export")
    EX.export(rows_, at, "conv_id")
    assert EX.load(spark, at, "conv_id").count() == 3
    with pytest.raises(Exception, match="exists"):
        EX.export(rows_, at, "conv_id")
    part = next(p for p in (tmp_path / "export" / "rows").glob("part-*.json") if p.stat().st_size)
    part.write_text(part.read_text().replace("text ", "test ", 1))
    for crc in (tmp_path / "export" / "rows").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="hash"):
        EX.load(spark, at, "conv_id").count()
