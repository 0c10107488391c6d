"""Strict JSON and CSV that may be split anywhere, against the standard library."""

from __future__ import annotations

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from caseflow.sources import tables as S


def strict(raw):
    """What the standard library takes, without repeated keys and numbers that are none."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError
        return dict(items)

    def constant(_):
        raise ValueError

    def number(text):
        x = float(text)
        if x in (float("inf"), float("-inf")):
            raise ValueError
        return x

    try:
        return json.loads(raw, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except (ValueError, TypeError):
        return None


def test_strict_json(spark):
    raws = ['{"a":1}', '{"a":1,"a":1}', '{"b":{"a":1,"a":2}}', '{"a":NaN}', '[Infinity]', '-Infinity', '{"a":"NaN \\" Infinity"}', '{"NaN":1}', "[1e999]", "[1e308]", "[-1E+400]", "[1.5,2]", "", "nul", '{"a":1} x', '1,2', '1] [2', '1,"end"', '1,null', 'null', '"\\u00e9"', "[]", None, "{}", '{"a":"1e999"}', '"a\\\\"']
    got = spark.createDataFrame([(r,) for r in raws], "r string").select(F.to_json(S.strict_json(F.col("r")))).collect()
    assert [None if r[0] is None else json.loads(r[0]) for r in got] == [strict(r) for r in raws]


def by_library(path, columns):
    with open(path, encoding="utf-8-sig", newline="") as f:
        reader = csv.reader(f)
        header = next(reader)
        return {(n, reader.line_num, *(row[header.index(c)] for c in columns)) for n, row in enumerate(reader, 2) if row}


def written(path, seed, rows, end="\n"):
    rng = random.Random(seed)
    pieces = ["a", "b,", '"', '""', "\n", "é", " ", "'", "x" * 30, ""]
    field = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))

    def shown(f):
        # quotes where they are needed, sometimes where not; a quote inside a field that is not quoted is text
        if any(c in f for c in ',\n\r') or f.startswith('"') or rng.random() < 0.3:
            return '"' + f.replace('"', '""') + '"' + rng.choice(["", "", "tail", 'q"q'])
        return f

    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("﻿one,\"t\nwo\",three" + end)
        for k in range(rows):
            out.write("" if k % 17 == 5 else ",".join(shown(field()) for _ in range(3)))
            out.write(end)


@pytest.mark.parametrize("size", [50, 333, 4096, 1 << 27])
def test_csv_equals_the_library_in_any_splits(spark, tmp_path, size):
    files = {f"{k}.csv": 40 * k + 1 for k in range(1, 4)}
    for name, n in files.items():
        written(tmp_path / name, n, n)
    written(tmp_path / "4.csv", 4, 60, "\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {}
        df = S.csv_with_lines(spark, str(tmp_path), ["three", "t\nwo"])
        for r in df.collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], set()).add((r["ordinal"], r["line"], r["three"], r["t\nwo"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == {name: by_library(tmp_path / name, ["three", "t\nwo"]) for name in [*files, "4.csv"]}


def test_csv_that_is_refused(spark, tmp_path):
    for k, text in enumerate(["a,a\n1,2\n", "a,c\n1,2\n", "a,b\n1\n"]):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "x.csv").write_text(text)
        with pytest.raises(Exception, match="header|fields"):
            S.csv_with_lines(spark, str(tmp_path / f"{k}"), ["a", "b"]).collect()
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "x.csv").write_text("a,b\n")
    assert S.csv_with_lines(spark, str(tmp_path / "ok"), ["a", "b"]).collect() == []
