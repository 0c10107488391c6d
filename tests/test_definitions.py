"""Operators held to plain Python versions of their rules, on the cases that went wrong once."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from caseflow.functions import number as N
from caseflow.functions import text as X
from caseflow.operators import archive as A
from caseflow.operators import review as R
from caseflow.operators import selection as S


def test_numbers_round_as_the_double_says(spark):
    rng = random.Random(3)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 1.15, 12.25, 12.75, 0.125, 0.145, 0.915, 0.995, 0.9995, 99.95, 999.5, 1000.0, 0.1235, 0.0001, 0.00012345, 0.00001, 1e-9, 123456.789, 5e7, -0.25, -1.005]
    values += [rng.randrange(10**7) / 1000 for _ in range(300)] + [round(rng.random(), 4) for _ in range(300)] + [rng.random() * 10 ** rng.randint(-8, 9) for _ in range(300)] + [rng.randrange(4000) / 32 for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(N.fixed(F.col("x"), 1), N.fixed(F.col("x"), 2), N.short(F.col("x"))).collect()
    for v, r in zip(values, got, strict=True):
        assert (r[0], r[1]) == (f"{v:.1f}".replace("-0.0", "-0.0"), f"{v:.2f}"), v
        if abs(v) < 999.5:
            assert r[2] == f"{v:.3g}", v


def test_white_space_of_any_kind(spark):
    texts = ["", " ", "\t", " 　\u0085", "\x1f", " a\n", " a b ", "a", None, "​", "ß", "STRASSE"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip(F.col("t")), X.blank(F.col("t")), X.folded(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else t.strip() for t in texts]
    assert [r[1] for r in got] == [t is None or not t.strip() for t in texts]
    assert [r[2] for r in got] == [None if t is None else t.casefold() for t in texts]


def test_shuffles_end(spark):
    rows = [(1, i, "x") for i in range(3)] + [(2, 0, "a"), (2, 1, "a"), (2, 2, "b")] + [(3, 0, "p"), (3, 1, "q")] + [(4, i, f"item{i}") for i in range(9)]
    got = A.hash_shuffle(spark.createDataFrame(rows, "c int, i int, item string"), "c", "item", ["i"], "p").collect()
    assert len(got) == len(rows)
    for case in (1, 2, 4):
        order = [r["i"] for r in sorted((r for r in got if r["c"] == case), key=lambda r: r["position"])]
        assert order not in (sorted(order), sorted(order, reverse=True))
    assert {r["salt"] for r in got if r["c"] == 3} == {0}
    salt = next(r["salt"] for r in got if r["c"] == 4)
    by_hash = sorted(range(9), key=lambda i: hashlib.sha256(f"p:4:{salt}:item{i}".encode()).hexdigest())
    assert [r["i"] for r in sorted((r for r in got if r["c"] == 4), key=lambda r: r["position"])] == by_hash


def dealt(queues, budget, known=()):
    """One new item of each request in turn."""
    queues, seen, out = {r: list(q) for r, q in sorted(queues.items())}, set(known), []
    while len(out) < budget and any(queues.values()):
        for r, q in queues.items():
            while q and q[0] in seen:
                q.pop(0)
            if q and len(out) < budget:
                seen.add(q[0])
                out.append((r, q.pop(0)))
    return out


def test_round_robin_counts_items_once(spark):
    rng = random.Random(6)
    pools = {0: {"r": ["A", "A", "A", "A", "B"]}, 1: {"a": ["x"], "b": ["x", "y"], "c": ["x", "y"]}}
    for p in range(2, 14):
        pools[p] = {f"r{k}": [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for k in range(rng.randint(1, 5))}
    rows = [(p, r, n, i) for p, qs in pools.items() for r, q in qs.items() for n, i in enumerate(q)] + [(1, "a", 9, None)]
    df = spark.createDataFrame(rows, "p int, r string, n int, item string").repartition(3)
    for budget in (1, 2, 5, 30):
        got = {}
        for r in S.round_robin(df, ["p"], "r", ["n"], "item", budget).orderBy("p", "place").collect():
            got.setdefault(r["p"], []).append((r["r"], r["item"]))
        assert got == {p: d for p, qs in pools.items() if (d := dealt(qs, budget))}
    known = spark.createDataFrame([(1, "x")], "p int, item string")
    assert [(r["r"], r["item"]) for r in S.round_robin(df.where("p = 1"), ["p"], "r", ["n"], "item", 5, known).orderBy("place").collect()] == [("b", "y")]


def test_templates_and_slugs(spark):
    df = spark.createDataFrame([("x{b}", " ", None)], "a string, b string, c string")
    fill = lambda t: df.select(A.filled(t, {k: F.col(k) for k in "abc"})).first()[0]
    assert fill("{a}|{b}|{c}|{missing}") == "X{b}| |unknown|unknown" and fill("no field") == "No field" and fill("") == ""
    names = ["a_", "..", "", "a b/c", "-x-", "é", "a" * 100, "._-a-_.", "x" * 79 + "!y"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(A.slug(F.col("n"))).collect()]
    assert got == [re.sub(r"[^A-Za-z0-9._-]+", "-", n).strip("._-")[:80] or "record" for n in names]


def test_blank_explanations_and_repeated_searches(spark):
    items = spark.createDataFrame([("r", 1, "a", "\t"), ("r", 2, "b", "why"), ("r", 3, "c", " ")], "run string, n int, id string, why string")
    assert [(r["n"], r["rule_id"]) for r in R.rejected_items(items, "run", "n", "id", F.lit(True), "why").orderBy("n").collect()] == [(1, "unexplained"), (3, "unexplained")]
    searches = spark.createDataFrame([("r", 1, "Straße", 0, 5), ("r", 2, "\tSTRASSE ", 0, 5), ("r", 3, "strasse", 1, 5)], "run string, n int, q string, s int, e int")
    assert [(r["n"], r["rule_id"]) for r in R.rejected_searches(searches, "run", "n", "q", "s", "e", 0, 9).collect()] == [(2, "duplicate")]
    labels = spark.createDataFrame([(1, "\n"), (2, "x")], "k int, label string")
    assert {(r["k"], r["reason"]) for r in A.availability(labels, labels, "k", "label").collect()} == {(1, "blank_placeholder_rows"), (2, None)}


def test_split_manifest(spark):
    rows = spark.createDataFrame([("g1", "train", "case"), ("g2", "unassigned", "case"), ("g3", "test", "case"), ("g4", "train", "surgeon"), ("g5", "train", "case")], "g string, part string, strategy string")
    manifest = spark.createDataFrame([("g1", "train", "case"), ("g2", "train", "case"), ("g3", "train", "case"), ("g4", "train", "case")], "g string, assigned string, strategy string")
    assert {r["g"] for r in A.split_disagreement(rows, "g", "part", manifest).collect()} == {"g3", "g4", "g5"}
    assert {r["g"] for r in A.split_disagreement(rows.drop("strategy"), "g", "part", manifest.drop("strategy")).collect()} == {"g3", "g5"}


def test_causal_inputs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "a")], "src string, dst string")
    assets = spark.createDataFrame([("a", "image", 1, True), ("b", "image", None, True), ("c", "teacher", None, False), ("c", "teacher", 9, False), ("y", "image", 99, True), ("x", "image", 0, True)], "node string, role string, frame int, image boolean")
    notes = spark.createDataFrame([("b", "outcome", 1), ("a", "note", 7), ("c", "note", None), ("a", "note", 2)], "node string, kind string, frame int")
    asked = spark.createDataFrame([("a", 5)], "node string, cutoff int")
    got = {tuple(r) for r in R.causal_violations(asked, edges, assets, ["teacher"], notes).collect()}
    assert got == {("a", "b", "unknown_frame"), ("a", "c", "role"), ("a", "b", "outcome"), ("a", "a", "future_annotation"), ("a", "c", "future_annotation")}
