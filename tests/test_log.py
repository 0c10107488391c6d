"""The append-only log: the rule of acceptance in plain Python, batch and stream; lines and files."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from caseflow.operators import log as L
from caseflow.streaming import replay as R

KINDS = ["a", "b"]
SCHEMA = "case_id int, seq long, t_ms long, kind string, cites array<long>, rule_id string"


def kept(rows):
    """(case, seq) -> id or None, one append after another."""
    out, last, ids = {}, {}, {}
    for case, seq, t, kind, cites, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = ids.setdefault(case, {})
        ok = kind in KINDS and t is not None and t >= last.get(case, t) and all(c in mine for c in cites or [])
        if ok:
            last[case] = t
            mine[seq] = f"E{len(mine) + 1:06d}"
        out[case, seq] = mine.get(seq)
    return out


def sample(seed=5, n=400):
    rng = random.Random(seed)
    rows = []
    for case in (1, 2, 3):
        for seq in range(n if case < 3 else 3):
            cites = None if seq % 7 == 0 else [seq - rng.randint(1, 9) for _ in range(rng.choice([0, 0, 0, 1, 2]))]
            rows.append((case, seq, None if rng.random() < 0.02 else seq * 10 + rng.randint(-25, 25), rng.choice(["a", "a", "a", "b", "odd", None] if rng.random() < 0.3 else KINDS), cites, "own"))
    rng.shuffle(rows)
    return rows


def test_refused_appends_change_nothing(spark):
    rows = [(1, 1, 10, "a", [], ""), (1, 2, 50, "a", [99], ""), (1, 3, 20, "a", [], ""), (1, 4, 60, "a", [2], ""), (1, 5, 19, "b", [1], ""), (1, 6, 70, "z", [], ""), (1, 7, 70, "b", [1, None], ""), (1, 8, 70, "b", [1, 3], "")]
    got = L.append(spark.createDataFrame(rows, SCHEMA), "case_id", "seq", "t_ms", "kind", "cites", KINDS).orderBy("seq").collect()
    assert [r["log_id"] for r in got] == ["E000001", None, "E000002", None, None, None, None, "E000003"]
    assert [r["rule_id"] for r in got] == [None, "unknown_citation", None, "unknown_citation", "time_backwards", "unknown_type", "unknown_citation", None]


def test_batch_equals_appending_one_by_one(spark):
    rows = sample()
    want = kept(rows)
    got = {(r["case_id"], r["seq"]): r["log_id"] for r in L.append(spark.createDataFrame(rows, SCHEMA).repartition(5), "case_id", "seq", "t_ms", "kind", "cites", KINDS).collect()}
    assert got == want and 200 < sum(v is not None for v in got.values()) < len(got)
    assert L.append(spark.createDataFrame([], SCHEMA), "case_id", "seq", "t_ms", "kind", "cites").collect() == []


def test_stream_equals_batch_and_late_rows_are_dead_letters(spark, tmp_path):
    rows = sample(9, 90)
    L.with_state_store(spark)
    # four files, the later the newer; two rows arrive when the log is past them
    late = [(1, 5, 50, "a", [], ""), (2, 7, 70, "b", [], "")]
    parts = [[r for r in rows if 25 * k <= r[1] < 25 * (k + 1) and r[:2] not in {x[:2] for x in late}] for k in range(4)]
    parts[2] += late
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (name,) = [f for f in os.listdir(tmp_path / f"w{k}") if f.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"w{k}" / name, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = R.drain(L.append_stream(stream, "case_id", "seq", "t_ms", "kind", "cites", KINDS), f"{tmp_path}/out", f"{tmp_path}/c").collect()
    assert {(r["case_id"], r["seq"]) for r in got if r["rule_id"] == "late"} == {x[:2] for x in late}
    want = kept([r for r in rows if r[:2] not in {x[:2] for x in late}])
    assert {(r["case_id"], r["seq"]): r["log_id"] for r in got if r["rule_id"] != "late"} == want


EVENTS = [
    ("c", "E000001", 0, 0, 1, "anatomy_visible", "durotomy", None, 1.0, [1], [], "t", {}),
    ("c", "E000002", 5000, 4000, 6, "instrument_entered", "needle driver", None, 0.91234, [5, 6], [], "t", {}),
    ("c", "E000003", 6000, 6000, 7, "tip_near_structure", "needle driver", "durotomy", 1.0, [], [], "t", {"distance": "0.0123", "b": "x"}),
    ("c", "E000004", 6049, 6049, 7, "alert", "rule", "", 0.5, None, ["E000003", "E000001"], "r", None),
]


def events(spark):
    return spark.createDataFrame(EVENTS, "case_id string, event_id string, t_ms long, onset_ms long, frame_index long, type string, subject string, object string, confidence double, evidence_frames array<long>, cites array<string>, producer string, data map<string,string>")


def test_lines(spark):
    assert [r[0] for r in events(spark).orderBy("event_id").select(L.line(data=F.col("data"))).collect()] == [
        "E000001 t=0.0s anatomy_visible durotomy (frames=1)",
        "E000002 t=5.0s instrument_entered needle driver (onset=4.0s, conf=0.91, frames=5-6)",
        "E000003 t=6.0s tip_near_structure needle driver -> durotomy (b=x, distance=0.0123)",
        "E000004 t=6.0s alert rule (conf=0.50, cites=E000003,E000001)",
    ]


def test_files(spark, tmp_path):
    L.write_lines(events(spark), "case_id", f"{tmp_path}/log")
    (file,) = [f for f in (tmp_path / "log" / "case_id=c").iterdir() if f.suffix == ".txt"]
    first, second = file.read_text().splitlines()[:2]
    assert first.startswith('{"event_id":"E000001","t_ms":0,"onset_ms":0,"frame_index":1,"type":"anatomy_visible","subject":"durotomy","object":null,"confidence":1.0') and '"confidence":0.9123' in second
    back = {r["event_id"]: r for r in L.read_lines(spark, f"{tmp_path}/log").collect()}
    assert len(back) == 4 and back["E000003"]["data"] == {"distance": "0.0123", "b": "x"} and back["E000002"]["evidence_frames"] == [5, 6] and back["E000004"]["data"] == {}
