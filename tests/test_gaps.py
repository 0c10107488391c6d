"""Gap recovery on worked examples: frames at whole seconds, their number in their name."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import gaps as G


def tables(spark, moments, supplied, rounds):
    """moments: {id: frames}; rounds: [(searches [(start, end, returned frames)], {frame: decision})]."""
    members = [("r", m, f"f{i}", i * 1000) for m, fs in moments.items() for i in fs]
    searches = [("r", n, k, s[0], s[1]) for n, (ss, _) in enumerate(rounds) for k, s in enumerate(ss)]
    retrieved = [("r", n, k, f"f{i}", i * 1000) for n, (ss, _) in enumerate(rounds) for k, s in enumerate(ss) for i in s[2]]
    decisions = [("r", n, f"f{i}", i * 1000, d) for n, (_, ds) in enumerate(rounds) for i, d in ds.items()]
    make = spark.createDataFrame
    return {
        "runs": make([("r",)], "run string"), "members": make(members, "run string, moment_id int, frame_id string, t_ms long"), "supplied": make([("r", f"f{i}") for i in supplied], "run string, frame_id string"),
        "searches": make(searches, "run string, round int, search int, start_ms long, end_ms long"), "retrieved": make(retrieved, "run string, round int, search int, frame_id string, t_ms long"),
        "decisions": make(decisions, "run string, round int, frame_id string, t_ms long, decision string"),
    }


def rates(t, tolerance=400, most=10_000):
    got = G.rates(t["runs"], t["members"], t["supplied"], t["searches"], t["retrieved"], t["decisions"], tolerance, F.lit(13_000), most).collect()
    return {r["stage"]: (r["count"], r["denominator"], r["recall"]) for r in got}


KEEP = "keep"


def test_stages(spark):
    t = tables(spark, {1: [1], 2: [5], 3: [9], 4: [11]}, [1, 5], [([(8800, 9200, [9]), (10800, 11200, [11])], {1: KEEP, 5: KEEP}), ([], {1: KEEP, 5: KEEP, 9: KEEP, 11: "drop"})])
    got = rates(t)
    assert got["initial_requested"] == (2, 2, 1.0) and got["cumulative_retrieved_exact"] == (2, 2, 1.0) and got["final_retained"] == (1, 2, 0.5) and got["final_retained_temporal_proxy"] == (0, 2, 0.0)
    assert [tuple(r) for r in G.progress(t["members"], t["supplied"], t["searches"], t["retrieved"], t["decisions"], 400, F.lit(13_000)).orderBy("round").collect()] == [("r", 0, 2, 2), ("r", 1, 2, 2)]
    none = G.session_violations(t["supplied"], t["searches"], t["retrieved"], t["decisions"], F.lit(13_000)).collect()
    assert none == []
    # nothing missing: no rate
    assert {v[2] for v in rates(tables(spark, {1: [1]}, [1], [([], {1: KEEP})])).values()} == {None}


def test_broad_searches_earn_nothing_for_asking(spark):
    t = tables(spark, {1: [1], 2: [5], 3: [9], 4: [11]}, [9, 11], [([(0, 13_000, [5]), (800, 1600, [])], {9: KEEP, 11: KEEP})])
    got = rates(t)
    assert got["cumulative_requested"] == (1, 2, 0.5) and got["cumulative_retrieved"] == (1, 2, 0.5) and got["final_retained"] == (0, 2, 0.0)
    assert tuple(G.cost(t["runs"], t["searches"], t["retrieved"]).first()) == ("r", 2, 1, 13_800, 13_000, 1, 1)
    idle = tables(spark, {1: [1]}, [1], [([], {1: KEEP})])
    assert tuple(G.cost(idle["runs"], idle["searches"], idle["retrieved"]).first()) == ("r", 0, 0, 0, 0, 0, 0)


def test_proxies(spark):
    t = tables(spark, {1: [1], 2: [5], 3: [9], 4: [11]}, [9, 11], [([(1500, 2500, [2])], {9: KEEP, 11: KEEP}), ([], {9: KEEP, 11: KEEP, 2: KEEP})])
    got = rates(t, 1100)
    assert got["cumulative_retrieved_exact"][0] == 0 and got["cumulative_retrieved_temporal_proxy"][0] == 1 and got["final_retained"] == (1, 2, 0.5)
    # near two moments: counts for none, though both were asked for
    t = tables(spark, {1: [2], 2: [4], 3: [9], 4: [11]}, [9, 11], [([(2800, 3200, [3])], {9: KEEP, 11: KEEP})])
    got = rates(t, 1200)
    assert got["cumulative_requested"] == (2, 2, 1.0) and got["cumulative_retrieved"] == (0, 2, 0.0)
    kinds = lambda t, tolerance: {r["frame_id"]: (r["match_kind"], r["moment_ids"]) for r in G.matched(t["retrieved"], t["members"], tolerance).collect()}
    assert kinds(t, 1200) == {"f3": ("ambiguous_temporal_proxy", [1, 2])}
    # between two frames of one moment, near neither
    t = tables(spark, {1: [1, 5], 2: [9], 3: [11]}, [9, 11], [([(2900, 3100, [3])], {9: KEEP, 11: KEEP})])
    assert rates(t)["cumulative_requested"] == (0, 1, 0.0) and kinds(t, 400) == {"f3": ("outside_reference_needs_review", [])}
    assert kinds(tables(spark, {1: [1, 5]}, [], [([(0, 9000, [5])], {})]), 0) == {"f5": ("exact_reference_member", [1])}


def test_session_rules(spark):
    t = tables(spark, {1: [1], 2: [5]}, [1, 5], [([(0, 2000, [2, 7]), (5, 5, []), (0, 99_000, [2])], {1: KEEP, 9: KEEP}), ([(0, 6000, [5])], {1: "maybe", 5: KEEP, 2: KEEP, 7: "drop"})])
    got = sorted((r["round"], r["rule_id"], r["frame_id"]) for r in G.session_violations(t["supplied"], t["searches"], t["retrieved"], t["decisions"], F.lit(13_000)).fillna("").collect())
    assert got == sorted([(0, "interval", ""), (0, "interval", ""), (0, "outside", "f7"), (0, "repeated", "f2"), (0, "not_supplied", "f9"), (0, "undecided", ""), (1, "decision", "f1"), (1, "repeated", "f5")])
