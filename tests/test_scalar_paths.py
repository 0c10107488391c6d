"""Nested measures as rows, against a plain recursion."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from caseflow.operators import metrics as M


def flat(value, prefix="", leave=()):
    out = {}
    for k, v in sorted(value.items()) if isinstance(value, dict) else ():
        if not prefix and k in leave:
            continue
        name = k.replace("_", " ").replace("-", " ").capitalize()
        name = f"{prefix} / {name}" if prefix else name
        if isinstance(v, dict):
            out |= flat(v, name)
        elif not isinstance(v, list):
            out[name] = None if v is None else json.dumps(v) if not isinstance(v, str) else v
    return out


def test_scalar_paths(spark):
    values = {
        1: {"a_b": 1, "nested": {"X-Y": True, "deep": {"deeper": {"deepest_one": 2.5, "list": [1, {"no": 1}]}}, "none": None}, "text": "s", "list": [1]},
        2: {}, 3: [1, {"a": 1}], 4: 5, 5: {"schema_version": "v", "in": {"schema_version": "kept"}}, 6: {"only": {"objects": {}}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()] + [(7, None)], "id int, j string").select("id", F.try_parse_json("j").alias("m"))
    got = {}
    for r in M.scalar_paths(df, ["id"], "m", ("schema_version",)).collect():
        got.setdefault(r["id"], {})[r["path"]] = r["scalar"]
    assert got == {k: f for k, v in values.items() if (f := flat(v, leave=("schema_version",)))}
    assert M.scalar_paths(df.limit(0), ["id"], "m").collect() == []
