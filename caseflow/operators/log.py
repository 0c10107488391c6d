"""The append-only event log: acceptance of appends as a sequential decision, in batch and as keyed state of a stream, its lines and its files.

An append is taken where its type is known, its time is not before that of the last one taken, and all events that it cites were
taken before it. A refused append changes nothing: later ones neither measure their time by it nor may cite it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseflow.functions import number as N
from caseflow.functions import text as X
from caseflow.operators import fold

# fixed values: the types of events that a log takes
EVENT_TYPES = [
    "instrument_entered", "instrument_left", "anatomy_visible", "anatomy_hidden", "tip_near_structure", "tip_cleared_structure", "view_empty",
    "view_restored", "step_changed", "step_unexpected", "alert",
]

_ADDS = "rule_id string, log_id string"


class Taken:
    """What later appends of a case can see: the last time, how many were taken, and which of those that anyone cites."""

    def __init__(self) -> None:
        self.last: int | None = None
        self.n = 0
        self.ids: set = set()


def verdict(t: int | None, kind: str | None, cites: Iterable | None, last: int | None, kinds: frozenset[str], known) -> str | None:
    """The first rule that an append breaks, or null; known(id) tells whether an event was taken."""
    if kind not in kinds:
        return "unknown_type"
    if t is None or (last is not None and t < last):
        return "time_backwards"
    return "unknown_citation" if cites is not None and not all(known(c) for c in cites) else None


def append(events: DataFrame, case: str, order: str, t: str, kind: str, cites: str, kinds: list[str] = EVENT_TYPES) -> DataFrame:
    """events with rule_id (null where the log takes the event, else the first rule that it breaks) and log_id (E000001, ... in order).

    unknown_type, time_backwards (a null time too), unknown_citation (cites is an array of values of `order` in the same case; a null entry is unknown, a null array is empty).
    A case's events are folded in order; only events that some event of their case cites are remembered, so that a
    task's memory is the citations of one case and a batch of rows.
    """
    cited = events.select(F.col(case).alias("__case"), F.explode(cites).alias("__cited")).distinct().withColumn("__wanted", F.lit(True))
    marked = events.join(cited, F.col(case).eqNullSafe(F.col("__case")) & (F.col(order) == F.col("__cited")), "left").drop("__case", "__cited")
    allowed = frozenset(kinds)

    def step(state: Taken, row: dict) -> tuple:
        rule = verdict(row[t], row[kind], row[cites], state.last, allowed, state.ids.__contains__)
        if rule:
            return rule, None
        state.last, state.n = row[t], state.n + 1
        if row["__wanted"]:
            state.ids.add(row[order])
        return None, f"E{state.n:06d}"

    return fold.scan(marked, [case], [order], [order, t, kind, cites, "__wanted"], Taken, step, _ADDS).drop("__wanted")


def _plain(value):
    """A value of pandas or numpy as Python's own."""
    return value.item() if hasattr(value, "item") else value


class _Appender(StatefulProcessor):
    """A case's log as state: its last time and order, its length, and a table of the events taken, which the state store holds on disk."""

    def __init__(self, names: tuple[str, str, str, str, str], kinds: list[str], order_type: str):
        self.names, self.kinds, self.order_type = names, frozenset(kinds), order_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", f"last long, seen {self.order_type}, n long")
        self.taken = handle.getMapState("taken", f"id {self.order_type}", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, order, t, kind, cites = self.names
        last, seen, n = self.head.get() if self.head.exists() else (None, None, 0)
        before, new = seen, set()

        def known(i) -> bool:
            return i is not None and (i in new or self.taken.containsKey((_plain(i),)))

        part = pd.concat(list(rows)).sort_values(order, kind="stable")
        rules, ids = [], []
        for i, at, what, cited in zip(part[order], part[t], part[kind], part[cites], strict=True):
            at = None if pd.isna(at) else int(at)
            i = _plain(i)
            rule = "late" if before is not None and i <= before else verdict(at, what, cited, last, self.kinds, known)
            seen = i if seen is None else max(seen, i)
            if rule is None:
                last, n = at, n + 1
                new.add(i)
                self.taken.updateValue((i,), (n,))
            rules.append(rule)
            ids.append(None if rule else f"E{n:06d}")
        self.head.update((last, seen, n))
        yield part.drop(columns=["rule_id", "log_id"], errors="ignore").assign(rule_id=rules, log_id=ids)

    def close(self) -> None:
        pass


def append_stream(stream: DataFrame, case: str, order: str, t: str, kind: str, cites: str, kinds: list[str] = EVENT_TYPES) -> DataFrame:
    """What append() does, as events arrive. Refused events are the dead letters: those with a rule_id.

    rule `late`: an event that comes in a later batch than one of its case with the same or a later order; the log is past it. The session needs
    the RocksDB state store, so that what was taken is looked up on disk and not held in memory.
    """
    adds = T.StructType.fromDDL(_ADDS).fields
    schema = T.StructType([*(f for f in stream.schema.fields if f.name not in {a.name for a in adds}), *adds])
    step = _Appender((case, order, t, kind, cites), kinds, stream.schema[order].dataType.simpleString())
    return stream.groupBy(case).transformWithStateInPandas(step, schema, "Append", "none")


def with_state_store(spark: SparkSession) -> None:
    """Sets the state store that append_stream() and the session need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- lines and files --------------------------------------------------------------------------------------------------


def line(data: Column | None = None) -> Column:
    """One compact line of an event: id, time, type, subject and object, then in brackets onset, confidence, frames, data and citations.

    Columns event_id, t_ms, type, subject, object, onset_ms, confidence, evidence_frames, cites; data is a map of strings whose
    values that are decimal numbers are shown with three significant digits. Details that say nothing new are left out.
    """
    seconds = lambda c: F.concat(N.fixed(F.col(c) / 1000.0, 1), F.lit("s"))
    frames = F.col("evidence_frames")
    span = F.when(F.size(frames) == 1, F.element_at(frames, 1).cast("string")).otherwise(F.concat_ws("-", F.element_at(frames, 1).cast("string"), F.element_at(frames, -1).cast("string")))
    pairs = F.array() if data is None else F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"].rlike("^-?[0-9]+[.][0-9]+$"), N.short(e["value"].try_cast("double"))).otherwise(e["value"])))
    details = F.concat(
        F.array(
            F.when(F.col("onset_ms") != F.col("t_ms"), F.concat(F.lit("onset="), seconds("onset_ms"))),
            F.when(F.col("confidence") < 1, F.concat(F.lit("conf="), N.fixed(F.col("confidence").cast("double"), 2))),
            F.when(F.size(F.coalesce(frames, F.array())) > 0, F.concat(F.lit("frames="), span)),
        ),
        F.coalesce(pairs, F.array()).cast("array<string>"),
        F.array(F.when(F.size(F.coalesce("cites", F.array())) > 0, F.concat(F.lit("cites="), F.array_join("cites", ",")))),
    )
    inside = F.array_join(F.array_compact(details), ", ")
    who = F.concat_ws(" -> ", "subject", F.nullif("object", F.lit("")))
    return F.concat(F.concat_ws(" ", "event_id", F.concat(F.lit("t="), seconds("t_ms")), "type", who), F.when(inside != "", F.concat(F.lit(" ("), inside, F.lit(")"))).otherwise(""))


#: An event as its file has it.
FILE = "event_id string, t_ms long, onset_ms long, frame_index long, type string, subject string, object string, confidence double, evidence_frames array<long>, cites array<string>, producer string, data map<string,string>"


def write_lines(events: DataFrame, case: str, path: str) -> None:
    """One JSON object a line, nulls kept, a folder of files by case; lines of a file are in log order."""
    names = [f.name for f in T.StructType.fromDDL(FILE).fields]
    rounded = events.withColumn("confidence", F.round("confidence", 4))
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rounded.repartition(case).sortWithinPartitions(case, "t_ms", "event_id").select(F.col(case), text.alias("value")).write.partitionBy(case).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of such files, with the case; blank lines are none, and a line that is no event fails the read. Where object, data or producer is missing, it is null, empty or ''."""
    lines = spark.read.text(path).where(~X.blank(F.col("value")))
    at = lines.select(*[c for c in lines.columns if c != "value"], F.from_json("value", FILE, {"mode": "FAILFAST"}).alias("e"))
    x = at.select(*[c for c in at.columns if c != "e"], "e.*")
    return x.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "producer": F.coalesce("producer", F.lit("")), "data": F.coalesce("data", F.create_map().cast("map<string,string>"))})
