"""What watched cases cost: shuffles of a plan, columns read from Arrow, state variables of a case."""

import json
import os

import pyarrow as pa
from pyspark.sql import functions as F

from caseflow.operators import fold
from caseflow.operators import log as L
from caseflow.plans import catalogue, registry
from caseflow.streaming import session as S
from tests.session import SMALL


def test_values_are_those_of_arrow():
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.list_(pa.struct([("label", pa.string()), ("n", pa.int64()), ("tip", point)]))
    rows = [[{"label": "a", "n": 1, "tip": {"x": 0.5, "y": None}}, {"label": None, "n": None, "tip": None}], None, [], [None, {"label": "b", "n": 2**60, "tip": {"x": float("inf"), "y": -0.0}}]]
    array = pa.array([*rows, *rows], kind)
    for part in (array, array.slice(3, 4), array.slice(1, 1), array.slice(0, 0)):
        assert fold._values(part) == part.to_pylist()
    for other in (pa.array([True, None]), pa.array([None, None], pa.string()), pa.array(["x", None, "x"]), pa.array([[("k", "v")]], pa.map_(pa.string(), pa.string()))):
        assert fold._values(other) == other.to_pylist()


def test_lines_are_shuffled_by_order_and_by_case_only(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["session_log"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # lines and orders by order, questions by case, all rows by case
    assert plan.count("Exchange hashpartitioning") <= 4


def test_a_case_is_one_value_of_the_state_store():
    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Handle:
        def __init__(self):
            self.values, self.due = {}, []

        def getValueState(self, name, schema):
            return self.values.setdefault(name, Value())

        def registerTimer(self, at):
            self.due.append(at)

        def deleteTimer(self, at):
            self.due.remove(at)

    from pyspark.sql import Row

    detection = {"label": "A", "kind": "instrument", "confidence": 0.9, "tip": {"x": 0.1, "y": 0.1}, "box": None}
    rows = [Row(t_ms=t, frame_index=t, annotated=True, detections=[detection] if t < 3000 else [], question_id=None, text=None) for t in (1000, 2000, 3000, 4000)]
    handle, settings = Handle(), S.Settings(leave=2)
    out = []
    for row in rows:  # each as a batch of its own
        watcher = S._Watcher(settings)
        watcher.init(handle)
        out += list(watcher.handleInputRows((7,), iter([row]), None))
    memory, whole = S.Memory(), []
    for row in rows:
        whole += S.advance(settings, memory, row.asDict())
    assert [tuple(r)[1:] for r in out] == whole and json.dumps(list(handle.values)) == '["memory"]' and handle.due == [4000 + settings.gap_ms]


def test_groups_of_cases_are_watched_as_one_case_each(spark, tmp_path):
    """Cases share a key of the state store; frames late for other cases only are watched, as over tables; numbers that JSON lacks come through."""
    L.with_state_store(spark)
    seen = lambda c: [("A", "instrument", c, (0.5, float("nan")), None), ("R", "anatomy", 0.9, None, (0.4, 0.4, float("inf"), 0.6))]
    files = []
    for part in range(3):
        # case 0 comes a day behind the others
        files.append([(None if c == 7 else c, 100_000 + t - (90_000 if c == 0 else 0), t, True, seen(float("nan") if c == 3 else 0.8) if t % 4000 < 2000 else [], None, None) for c in range(12) for t in range(part * 5000, part * 5000 + 5000, 1000)])
    rows = f"case_id int, {S.ROW}"
    os.makedirs(tmp_path / "in")
    for k, part in enumerate(files):
        spark.createDataFrame(part, rows).withColumn("at", F.timestamp_millis("t_ms")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in os.listdir(tmp_path / "in" / str(k)):
            os.utime(tmp_path / "in" / str(k) / f, (1_700_000_000 + 100 * k,) * 2)
    settings = S.Settings(structures=("R",), gap_ms=60_000)
    stream = spark.readStream.schema(f"{rows}, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []
    watched = S.watch_stream(stream, "case_id", settings, groups=3)
    query = watched.writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    want = S.watch(spark.createDataFrame([r for part in files for r in part], rows), "case_id", settings)
    plain = lambda found: sorted(str(tuple(r)) for r in found if r["record"] != "closed")
    assert plain(got) == plain(want.collect()) and len(plain(got)) > 50
    assert {r["record"] for r in got} == {"event", "closed"} and {r["case_id"] for r in got if r["record"] == "closed"} == {0}
    assert 0 < max(keys) <= 2 * 3 * 2  # a value and a timer a group, by key and by time


def test_orders_in_a_folder_are_streamed(spark, tmp_path):
    for t in ("orders", "lineitem"):
        registry.table(spark, SMALL, t).repartition(2).write.parquet(f"{tmp_path}/{t}.parquet")
    log = lambda d: sorted(map(tuple, catalogue.queries()["stream_session_log"](spark, d).collect()), key=str)
    assert log(str(tmp_path)) == log(SMALL) != []
