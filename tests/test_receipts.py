"""Exports with a tree of hashes: against plain Python, what is refused, and the way to a changed row."""

from __future__ import annotations

import hashlib
import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseflow.operators import receipts as R


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def nodes(rows, depth):
    """{(depth, prefix): (n, hash)} by recursion over prefixes."""
    count = defaultdict(int)
    for k, t in rows:
        count[sha(str(k) if k is not None else ""), sha(t or "")] += 1
    out = {}

    def fold(prefix):
        if len(prefix) == depth:
            mine = {k: n for k, n in count.items() if k[0].startswith(prefix)}
            if not mine:
                return None
            out[depth, prefix] = (sum(mine.values()), sha("".join(sorted(sha(f"{a}:{h}:{n}") for (a, h), n in mine.items()))))
        else:
            below = [c for d in "0123456789abcdef" if (c := fold(prefix + d))]
            if not below:
                return None
            out[len(prefix), prefix] = (sum(n for n, _ in below), sha("".join(h for _, h in below)))
        return out[len(prefix), prefix]

    fold("")
    return out


def test_tree_equals_python(spark):
    rows = [(i % 150, f"text {i % 130}") for i in range(400)] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(4)
    assert [R.depth_for(n) for n in (0, 16, 17, 256, 257, 4097)] == [0, 0, 1, 1, 2, 3]
    for depth in (0, 1, 2):
        got = {(r["depth"], r["prefix"]): (r["n"], r["sha256"]) for r in R.tree(R.leaves(df, "k", "t"), depth).collect()}
        assert got == nodes(rows, depth)
    assert R.tree(R.leaves(df.limit(0), "k", "t"), 1).collect() == []


def message(role, text, image=None):
    return (role, [("text", text, None)] + ([("image", None, image)] if image else []))


def rows(spark, n=60, **more):
    data = [(i, [message("user", f"question {i}", f"img/{i % 5}.jpeg" if i % 2 else None), message("assistant", f"answer {i}")], "train", "final_assistant_turn", "causal_intraoperative_assistance") for i in range(n)]
    df = spark.createDataFrame(data, f"id long, messages {R.MESSAGES}, partition string, loss_scope string, intended_use string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def media(spark, n=5):
    return spark.createDataFrame([(f"img/{i}.jpeg", sha(str(i)), 16, 8) for i in range(n)], "location string, sha256 string, width int, height int")


def edit(path, change):
    """Rewrites the JSON rows, without the sums that the file system would compare."""
    for name in os.listdir(path):
        if name.endswith(".json"):
            lines = [json.loads(x) for x in open(f"{path}/{name}").read().splitlines()]
            with open(f"{path}/{name}", "w") as f:
                f.writelines(json.dumps(x) + "\n" for x in change(lines))
        elif name.endswith(".crc"):
            os.unlink(f"{path}/{name}")


def test_round_trip_and_changed_rows(spark, tmp_path):
    path = f"{tmp_path}/out"
    R.export(rows(spark), path, "id", media(spark))
    got = R.load(spark, path, "id", media=media(spark))
    assert got.count() == 60 and R.audit(spark, path, "id").collect() == []
    with pytest.raises(ValueError, match="changed"):
        R.load(spark, path, "id", media=media(spark).withColumn("width", F.lit(17)))
    for want, how in (("train", {"partition": "test"}), ("loss_scope", {"loss_scope": "all"}), ("intended_use", {"intended_use": "x"})):
        with pytest.raises(ValueError, match=want):
            R.load(spark, path, "id", **how)

    def change(lines):
        out = []
        for x in lines:
            if x["id"] == 17:
                x["messages"][1]["content"][0]["text"] = "Answer 17"
            if x["id"] != 23:
                out.append(x)
            if x["id"] == 5:
                out.append(x | {"id": 1005})
        return out

    edit(f"{path}/rows", change)
    assert {tuple(r) for r in R.audit(spark, path, "id").collect()} == {(17, "changed"), (23, "missing"), (1005, "added")}
    with pytest.raises(ValueError, match="rows are not those"):
        R.load(spark, path, "id")


def test_what_exports_refuse(spark, tmp_path):
    for k, (df, of, why) in enumerate([
        (rows(spark, 0), media(spark), "no rows"),
        (rows(spark).withColumn("partition", F.when(F.col("id") < 3, "test").otherwise("train")), media(spark), "partition"),
        (rows(spark, partition="unassigned"), media(spark), "explicit"),
        (rows(spark).withColumn("messages", F.slice("messages", 1, 1)), media(spark), "portable"),
        (rows(spark), media(spark, 4), "without entry"),
        (rows(spark), media(spark).union(media(spark).withColumn("height", F.lit(9))), "different bytes"),
    ]):
        with pytest.raises(ValueError, match=why):
            R.export(df, f"{tmp_path}/{k}", "id", of)
    R.export(rows(spark, 3, partition="unassigned"), f"{tmp_path}/p", "id", media(spark), preview=True)
    with pytest.raises(ValueError, match="draft"):
        R.load(spark, f"{tmp_path}/p", "id", partition="unassigned")
    assert R.load(spark, f"{tmp_path}/p", "id", preview=True, partition="unassigned").count() == 3
    # media that the messages do not name, and a receipt that was changed with its leaves
    media(spark, 5).write.mode("overwrite").parquet(f"{tmp_path}/p/media")
    with pytest.raises(ValueError, match="media are not"):
        R.load(spark, f"{tmp_path}/p", "id", preview=True, partition="unassigned")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        R.export(rows(spark, 3), f"{tmp_path}/p", "id", media(spark))


def test_request_text_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([("ü/\"", None, [1, 2])], "z string, a string, m array<int>")
    assert df.select(R.request_text(F.struct("z", "a", "m"))).first()[0] == json.dumps({"z": 'ü/"', "a": None, "m": [1, 2]}, ensure_ascii=False, separators=(",", ":"))
