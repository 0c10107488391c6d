"""A case watched as it happens: frames become events, events steps and alerts, alerts utterances; questions are asked on the way.

What happens at a frame depends on all that was decided before it, so a case is a keyed state: `advance` decides one frame from a
`Memory`, in a stream (`watch_stream`: the memories of a group of cases are one value of the state store) and over tables
(`watch`: the same decisions over rows sorted by Spark). Every memory is bounded by the number of labels, keys and open
questions of a case, never by its length.

Rows out, told apart by `record`: event (the log: ids E000001, ... by case), utterance (every offer to speak with its reason,
spoken or not), asked (a question with the frame that asked it), late (a dead letter: a frame before the last one), closed (a stretch
without frames of at least `gap_ms`).
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseflow.operators import fold

DETECTIONS = "array<struct<label:string,kind:string,confidence:double,tip:struct<x:double,y:double>,box:struct<x1:double,y1:double,x2:double,y2:double>>>"
#: What a row to watch is: a frame, or a question to be asked at the first frame at or after its time (text: the answer, where one is at hand).
ROW = f"t_ms long, frame_index long, annotated boolean, detections {DETECTIONS}, question_id string, text string"
OUT = (
    "record string, event_id string, t_ms long, onset_ms long, frame_index long, type string, subject string, object string, confidence double, evidence_frames array<long>, "
    "cites array<string>, data map<string,string>, key string, priority string, text string, reason string, question_id string, scheduled_ms long"
)
_NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
_PLACE = {c: i for i, c in enumerate(_NAMES)}
_OUT_ROW = Row("__case", *_NAMES)


@dataclass(frozen=True)
class Settings:
    """Thresholds. Distances are in picture heights; x is stretched by `aspect`."""

    enter: int = 1
    leave: int = 2
    least: float = 0.5
    near: float = 0.08
    clear_factor: float = 1.5
    near_frames: int = 1
    empty_frames: int = 3
    aspect: float = 16 / 9
    structures: tuple[str, ...] = ("durotomy",)
    #: (step, condition, labels): any, all or none of the labels in view; the first that holds.
    steps: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    initial: str = "idle"
    dwell: int = 3
    transitions: dict[str, list[str]] = field(default_factory=dict)
    expected: tuple[str, ...] = ()
    #: id, type, priority, message, and optional subject, object, present, absent, step, cooldown_ms.
    rules: tuple[dict, ...] = ()
    speak_least: float = 0.5
    cooldown_ms: int = 20_000
    per_minute: int = 4
    gap_ms: int = 60_000


class Track:
    """A label: the run of frames that are alike (in view or not), as long as decisions need it, and whether it counts as in view, since which event."""

    __slots__ = ("kind", "event", "here", "run")

    def __init__(self, kind: str, event: str | None = None, here: bool = False, run: list | None = None):
        self.kind, self.event, self.here, self.run = kind, event, here, run or []


@dataclass
class Memory:
    n: int = 0
    last_ms: int | None = None
    #: whether the stretch without frames since then has been told
    told: bool = False
    tracks: dict[str, Track] = field(default_factory=dict)
    #: by (instrument, structure): None while near, else the run of close frames
    pairs: dict[tuple[str, str], list | None] = field(default_factory=dict)
    empty: list = field(default_factory=list)
    view_lost: bool = False
    step: tuple[str, str | None] | None = None
    visited: list[str] = field(default_factory=list)
    candidate: str | None = None
    dwelt: list = field(default_factory=list)
    spoken: dict[str, int] = field(default_factory=dict)
    minute: list[int] = field(default_factory=list)
    open: list[tuple[int, str, str | None]] = field(default_factory=list)


def _row(record: str, t: int | None, **values) -> tuple:
    out: list = [None] * len(_NAMES)
    out[_PLACE["record"]], out[_PLACE["t_ms"]] = record, t
    for c, v in values.items():
        out[_PLACE[c]] = v
    return tuple(out)


class _Frame:
    """What one frame adds to the log."""

    def __init__(self, memory: Memory, t: int, index: int):
        self.memory, self.t, self.index, self.events, self.rows = memory, t, index, [], []

    def event(self, kind: str, subject: str, onset: int | None = None, frames: list[int] | None = None, **more) -> dict:
        self.memory.n += 1
        e = {"event_id": f"E{self.memory.n:06d}", "type": kind, "subject": subject, "object": None, "confidence": 1.0, "cites": [], "data": {}, **more}
        e |= {"onset_ms": self.t if onset is None else onset, "evidence_frames": frames or [], "frame_index": self.index}
        self.events.append(e)
        self.rows.append(_row("event", self.t, **e))
        return e


def _distance(tip, target: dict, aspect: float) -> float | None:
    box, point = target["box"], target["tip"]
    if box:
        # beside the box, or inside
        across, along = max(box["x1"] - tip["x"], 0.0, tip["x"] - box["x2"]), max(box["y1"] - tip["y"], 0.0, tip["y"] - box["y2"])
    elif point:
        across, along = abs(tip["x"] - point["x"]), abs(tip["y"] - point["y"])
    else:
        return None
    return math.sqrt((across * aspect) * (across * aspect) + along * along)


def _look(m: Memory, f: _Frame, s: Settings, seen: dict[str, dict]) -> None:
    """Labels that come into view and leave it, in order of their names."""
    for label in sorted(seen.keys() | m.tracks.keys()):
        now, track = seen.get(label), m.tracks.get(label)
        if track is None:
            track = m.tracks[label] = Track(now["kind"])
        if (now is not None) == (track.event is not None):  # as it counts: the next run begins where that changes
            track.here, track.run = now is not None, []
            continue
        need = s.enter if now else s.leave
        track.run = (track.run if track.here == bool(now) else [])[-(max(need, 1) - 1) :] if need > 1 else []
        track.run.append((f.index, f.t, now["confidence"] if now else 0.0))
        track.here = bool(now)
        if len(track.run) < need or track.here == (track.event is not None):
            continue
        tool = track.kind == "instrument"
        if now:
            kind, extra = "instrument_entered" if tool else "anatomy_visible", {"confidence": sum(c for *_, c in track.run) / need}
        else:
            kind, extra = "instrument_left" if tool else "anatomy_hidden", {}
            for pair in [p for p in m.pairs if p[0] == label]:
                del m.pairs[pair]
        e = f.event(kind, label, track.run[0][1], [i for i, *_ in track.run], **extra)
        track.event = e["event_id"] if now else None


def _touch(m: Memory, f: _Frame, s: Settings, seen: dict[str, dict]) -> None:
    """Tips that come near a structure, and clear it only beyond a wider distance."""
    for label in sorted(seen):
        tool = m.tracks[label]
        if tool.kind != "instrument" or tool.event is None or not seen[label]["tip"]:
            continue
        for structure in s.structures:
            pair, target = (label, structure), seen.get(structure)
            is_near = pair in m.pairs and m.pairs[pair] is None
            if target is None or m.tracks[structure].event is None:
                if not is_near:
                    m.pairs.pop(pair, None)
                continue
            far = _distance(seen[label]["tip"], target, s.aspect)
            if far is None:
                continue
            data = {"distance": str(round(far, 4))}
            if is_near and far > s.near * s.clear_factor:
                del m.pairs[pair]
                f.event("tip_cleared_structure", label, None, [f.index], object=structure, data=data)
            elif not is_near and far <= s.near:
                run = m.pairs[pair] = [*(m.pairs.get(pair) or []), (f.index, f.t)]
                if len(run) >= s.near_frames:
                    m.pairs[pair] = None
                    f.event("tip_near_structure", label, run[0][1], [i for i, _ in run], object=structure, confidence=seen[label]["confidence"] * target["confidence"], data=data)
            elif not is_near:
                m.pairs.pop(pair, None)


def _view(m: Memory, f: _Frame, s: Settings, seen: dict[str, dict]) -> None:
    if seen:
        if m.view_lost:
            f.event("view_restored", "view", None, [f.index])
        m.empty, m.view_lost = [], False
    elif not m.view_lost:
        m.empty.append((f.index, f.t))
        if len(m.empty) >= s.empty_frames:
            m.view_lost = True
            f.event("view_empty", "view", m.empty[0][1], [i for i, _ in m.empty])


def _holds(condition: str, labels: tuple[str, ...], visible: set[str]) -> bool:
    return bool(visible.intersection(labels)) if condition == "any" else visible.issuperset(labels) if condition == "all" else not visible


def _proceed(m: Memory, f: _Frame, s: Settings, visible: dict[str, str]) -> None:
    """A step is entered once its condition has held for `dwell` frames."""
    current = m.step[0] if m.step else s.initial
    step = next((name for name, condition, labels in s.steps if _holds(condition, labels, set(visible))), None)
    if step is None or step == current:
        m.candidate, m.dwelt = None, []
        return
    m.dwelt = [*(m.dwelt if step == m.candidate else []), (f.index, f.t)]
    m.candidate = step
    if len(m.dwelt) < s.dwell:
        return
    e = f.event("step_changed", step, m.dwelt[0][1], [i for i, _ in m.dwelt], cites=sorted(visible.values()), data={"from": current})
    early = [x for x in s.expected[: s.expected.index(step)] if x not in m.visited] if step in s.expected and step not in m.visited else []
    if step not in s.transitions.get(current, ()):
        reason = f"{current} -> {step} is not an allowed transition"
    else:
        reason = f"{step} began before {', '.join(early)} was observed" if early else None
    if reason:
        f.event("step_unexpected", step, cites=[e["event_id"]], data={"from": current, "reason": reason})
    m.step, m.candidate, m.dwelt = (step, e["event_id"]), None, []
    m.visited = sorted({*m.visited, step})


def said(message: str, fields: dict[str, str]) -> str:
    """A message with {name} replaced by its field, by `unknown` where there is none, and its first letter large; values are not looked into."""
    parts = message.split("{")
    text = parts[0] + "".join(fields.get(name, "unknown") + rest for name, _, rest in (p.partition("}") for p in parts[1:]))
    return text[:1].upper() + text[1:]


def _support(rule: dict, visible: dict[str, str], step: tuple | None) -> list[str] | None:
    """Events that a rule's state rests on; null where the state is another."""
    if any(x not in visible for x in rule.get("present", ())) or any(x in visible for x in rule.get("absent", ())):
        return None
    if rule.get("step") is not None and (not step or step[0] != rule["step"]):
        return None
    return [visible[x] for x in rule.get("present", ())] + ([step[1]] if rule.get("step") is not None else [])


def _offer(m: Memory, s: Settings, now: int, key: str, priority: str, confidence: float, cooldown: int | None, question: str | None) -> str:
    """The reason why an offer is spoken or not."""
    m.minute = [t for t in m.minute if now - t < 60_000]
    since = now - m.spoken[key] if key in m.spoken else None
    if question is not None:
        m.spoken[key] = now
        return "answer"
    if confidence < s.speak_least:
        return "low_confidence"
    if since is not None and since < (s.cooldown_ms if cooldown is None else cooldown):
        return "cooldown"
    if priority != "critical" and len(m.minute) >= s.per_minute:
        return "rate_limited"
    m.spoken[key] = now
    m.minute.append(now)
    return "spoken"


def _alert(m: Memory, f: _Frame, s: Settings, visible: dict[str, str]) -> None:
    """Rules that this frame's events meet: an alert in the log, and an offer to speak."""
    for e in list(f.events):
        for rule in s.rules:
            if rule["type"] != e["type"] or rule.get("subject", e["subject"]) != e["subject"] or rule.get("object", e["object"]) != e["object"]:
                continue
            support = _support(rule, visible, m.step)
            if support is None:
                continue
            text = said(rule["message"], e["data"] | {"subject": e["subject"], "object": e["object"] or "", "step": m.step[0] if m.step else ""})
            cites = [e["event_id"], *support]
            alert = f.event("alert", rule["id"], object=e["subject"], confidence=e["confidence"], cites=cites, data={"priority": rule["priority"], "message": text})
            key = f"rule:{rule['id']}:{e['subject']}"
            reason = _offer(m, s, f.t, key, rule["priority"], e["confidence"], rule.get("cooldown_ms"), None)
            f.rows.append(_row("utterance", f.t, key=key, priority=rule["priority"], text=text, reason=reason, cites=[alert["event_id"], *cites], confidence=e["confidence"], frame_index=f.index))


def advance(s: Settings, m: Memory, row: dict) -> list[tuple]:
    """Rows out of one row in; the memory goes on."""
    t = row["t_ms"]
    if row["question_id"] is not None:
        m.open = sorted([*m.open, (t, row["question_id"], row["text"])], key=lambda q: q[:2])
        return []
    if t is None or (m.last_ms is not None and t < m.last_ms):
        return [_row("late", t, frame_index=row["frame_index"])]
    f = _Frame(m, t, row["frame_index"])
    if m.last_ms is not None and t - m.last_ms >= s.gap_ms and not m.told:
        f.rows.append(_row("closed", m.last_ms))
    m.last_ms, m.told = t, False
    if row["annotated"]:
        detections = row["detections"]
        seen = {d["label"]: d for d in (() if detections is None else detections) if d["confidence"] >= s.least}
        for part in (_look, _touch, _view):
            part(m, f, s, seen)
    visible = {label: track.event for label, track in m.tracks.items() if track.event is not None and track.kind == "instrument"}
    if s.steps:
        _proceed(m, f, s, visible)
    if s.rules:
        _alert(m, f, s, visible)
    while m.open and m.open[0][0] <= t:
        at, question, text = m.open.pop(0)
        f.rows.append(_row("asked", t, question_id=question, scheduled_ms=at, frame_index=f.index, text=text))
        if text is not None:
            key = f"answer:{question}"
            f.rows.append(_row("utterance", t, key=key, priority="medium", text=text, reason=_offer(m, s, t, key, "medium", 1.0, None, question), question_id=question, confidence=1.0, frame_index=f.index))
    return f.rows


#: A question comes before a frame of its time.
ORDER = ["t_ms", "__frame", "frame_index"]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__frame", F.col("question_id").isNull())


def watch(rows: DataFrame, case: str, settings: Settings) -> DataFrame:
    """Rows out of all cases of a table with the columns of ROW: one pass over each case's rows in order.

    Frames that tie in time and index come in any order. A frame without time is late; a case of questions alone has no rows.
    """
    return fold.emit(_ordered(rows), [case], ORDER, [c.split(" ")[0] for c in ROW.replace(DETECTIONS, "d").split(", ")], Memory, partial(advance, settings), OUT)


def observed(frames: DataFrame, labels: DataFrame, case: str, index: str) -> DataFrame:
    """frames, a stream or a table, with annotated and detections from a static table of labels.

    labels: (case, index, label, kind, confidence, tip, box), one row a label or none: a frame that has any row is annotated, also where
    its label is null. The labels are gathered by frame before the join, so that the stream joins without state. Where a frame's index is
    its own among all cases, the labels need no case.
    """
    keys = [c for c in (case, index) if c in labels.columns]
    own = F.struct(*[F.col(c) for c in ("label", "kind", "confidence", "tip", "box")])
    by = labels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), own))).cast(DETECTIONS).alias("detections"))
    return frames.join(by, keys, "left").withColumn("annotated", F.col("detections").isNotNull())


class _Watcher(StatefulProcessor):
    """The memories of a key's cases as one value of the state store; a timer of event time tells of cases that have gone quiet.

    Here the key is the case. The value is a pickled map of each case to when it falls quiet (null: that has been told) and its memory, pickled by
    itself, so that the cases that a batch does not name cost no more than their bytes.
    """

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "cases binary")

    def _load(self) -> dict:
        kept = self.memory.get()
        return {} if kept is None else pickle.loads(kept[0])

    def _store(self, cases: dict, before: int | None) -> None:
        """before: the timer that the key has."""
        due = min((at for at, _ in cases.values() if at is not None), default=None)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and due != before:
            self.handle.registerTimer(due)
        self.memory.update((pickle.dumps(cases, pickle.HIGHEST_PROTOCOL),))

    def _parts(self, key: tuple, rows: Iterator[Row]) -> dict:
        """Rows by case."""
        return {key[0]: [row.asDict() for row in rows]}

    def _rows(self, rows: list[tuple]) -> Iterator[Row]:
        return iter([_OUT_ROW(*r) for r in rows])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cases = self._load()
        before = min((at for at, _ in cases.values() if at is not None), default=None)
        low = lambda v: (v is not None, v)
        out = []
        for case, part in self._parts(key, rows).items():
            m = _remembered(cases[case][1]) if case in cases else Memory()
            part.sort(key=lambda r: (low(r["t_ms"]), r["question_id"] is None, low(r["frame_index"])))
            for row in part:
                out += [(case, *values) for values in advance(self.settings, m, row)]
            cases[case] = None if m.last_ms is None or m.told else m.last_ms + self.settings.gap_ms, _plain(m)
        self._store(cases, before)
        return self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cases, out = self._load(), []
        now = expiredTimerInfo.getExpiryTimeInMs()
        past = max(now, timerValues.getCurrentWatermarkInMs() - 1)
        for case, (at, memory) in cases.items():
            if at is not None and at <= past:
                m = _remembered(memory)
                m.told = True
                cases[case] = None, _plain(m)
                out.append((case, *_row("closed", m.last_ms)))
        self._store(cases, None)  # Spark deletes the timer that has expired
        return self._rows(out)

    def close(self) -> None:
        pass


def _plain(m: Memory) -> bytes:
    """A memory as bytes, of plain values and in the order of its fields."""
    tracks = [(label, x.kind, x.event, x.here, x.run) for label, x in m.tracks.items()]
    return pickle.dumps([tracks if name == "tracks" else getattr(m, name) for name in _FIELDS], pickle.HIGHEST_PROTOCOL)


def _remembered(memory: bytes) -> Memory:
    m = Memory(*pickle.loads(memory))
    m.tracks = {label: Track(*values) for label, *values in m.tracks}
    return m


_FIELDS = [f.name for f in fields(Memory)]


class _Watchers(_Watcher):
    """The key is a group of cases: (case, row as JSON) in, all that a group gives as one record batch out. A visit to the state store, a batch
    to Spark and its schema cost more than the decisions of a case, and so are had once a group."""

    def __init__(self, settings: Settings, schema: pa.Schema):
        super().__init__(settings)
        self.schema = schema

    def _parts(self, key: tuple, rows: Iterator[Row]) -> dict:
        out: dict = {}
        for case, text, _ in rows:
            out.setdefault(case, []).append(_decoded(text))
        return out

    def _rows(self, rows: list[tuple]) -> Iterator[Row]:
        if not rows:
            return iter(())
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)
        return iter([Row(rows=batch.serialize().to_pybytes())])


_scan = json.JSONDecoder().scan_once


def _decoded(text: str) -> dict:
    """A row that to_json() wrote; numbers that JSON does not have came as strings."""
    row, _ = _scan(text, 0)
    if '"NaN"' in text or 'Infinity"' in text:
        for d in row["detections"] or ():
            d["confidence"] = d["confidence"] and float(d["confidence"])
            for place in (d["tip"], d["box"]):
                for c, v in (place or {}).items():
                    place[c] = v and float(v)
    return row


#: Groups of cases in the state store. A checkpoint holds to the number that it was begun with.
GROUPS = 1 << 15


def watch_stream(rows: DataFrame, case: str, settings: Settings, at: str = "at", late: str = "0 seconds", groups: int | None = GROUPS) -> DataFrame:
    """What watch() does, as rows arrive; needs log.with_state_store(). `at` is the time of t_ms as a timestamp of the same zero, the watermark's column.

    A stretch without frames is `closed` by the frame after it; the last one by a timer, once the watermark is `gap_ms` past the case's last frame.
    Nothing is dropped by the watermark: a frame that is late in its case comes out as such, one that is late for other cases only is watched.
    Cases share the state store's keys by groups (None: each has its own); a batch rewrites the bytes of all memories of the groups that it has rows of.
    """
    names = [c.split(" ")[0] for c in ROW.replace(DETECTIONS, "d").split(", ")]
    kind = rows.schema[case].dataType.simpleString()
    x, full = rows.withWatermark(at, late), f"__case {kind}, {OUT}"
    if groups is None:
        return x.select(case, *names).groupBy(case).transformWithState(_Watcher(settings), full, "Append", "EventTime").withColumnRenamed("__case", case)
    schema = pa.schema([(f.name, fold.arrow(f.dataType)) for f in T.StructType.fromDDL(full).fields])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("rows"):
                yield pa.ipc.read_record_batch(packed.as_buffer(), schema)

    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    x = x.select(F.col(case).alias("__case"), row.alias("__row"), F.pmod(F.xxhash64(case), F.lit(groups)).alias("__group"))
    out = x.groupBy("__group").transformWithState(_Watchers(settings, schema), "rows binary", "Append", "EventTime")
    return out.mapInArrow(unpack, full).withColumnRenamed("__case", case)


def split(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Runs a watched stream over all that is there now into one table a record kind: two outputs and dead letters of one query.

    A batch that is written again after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("record", "batch").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# --- summary ----------------------------------------------------------------------------------------------------------


def _percentiles(values: DataFrame, case: str, name: str) -> DataFrame:
    """count, p50, p95, max and mean of (case, name, value); a percentile is the value at the nearest rank, of two equally near ones the even."""
    from pyspark.sql import Window

    w = Window.partitionBy(case, name)
    at = lambda q: F.max(F.when(F.col("__i") == F.bround((F.col("__n") - 1) * q), F.col("value")))
    x = values.where("value is not null").withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy("value")) - 1)
    g = x.groupBy(case, name).agg(F.count(F.lit(1)).cast("double").alias("count"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    return g.selectExpr(case, f"stack(5, concat({name}, '.count'), count, concat({name}, '.p50'), round(p50, 2), concat({name}, '.p95'), round(p95, 2), concat({name}, '.max'), round(max, 2), concat({name}, '.mean'), round(mean, 2)) as (part, value)")


def summary(out: DataFrame, case: str, answers: DataFrame, timings: DataFrame, period_ms: float) -> DataFrame:
    """(case, part, value): counts of events by type, utterances by reason, questions by status, answer and stage times as percentiles, missed deadlines.

    out: rows of watch(), best written or checkpointed first, as each part reads them again. answers: (case, question_id, status, supported, elapsed_ms, staleness_ms), one row for each question at most.
    timings: (case, stage, ms), a row of stage `total` for each frame. A question that was never asked, whatever its answer, is `not_asked`.
    """
    n = lambda df, name: df.groupBy(case, name.alias("part")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    lit = F.lit
    events, said_ = out.where("record = 'event'"), out.where("record = 'utterance'")
    spoken: Column = F.col("reason").isin("spoken", "answer")
    asked = out.where("record = 'asked'").select(case, "question_id", lit(True).alias("__asked"))
    q = answers.join(asked, [case, "question_id"], "full").withColumn("status", F.coalesce("status", lit("agent_unavailable")))
    done = q.where("__asked")
    total = timings.where("stage = 'total'")
    times = timings.select(case, F.concat(lit("timing."), "stage").alias("name"), F.col("ms").cast("double").alias("value"))
    for c in ("elapsed_ms", "staleness_ms"):
        times = times.unionByName(done.select(case, lit(f"questions.{c}").alias("name"), F.col(c).cast("double").alias("value")))
    parts = [
        n(events, F.concat(lit("events."), "type")),
        n(said_, F.concat(lit("utterances.by_reason."), "reason")),
        n(said_, F.when(spoken, "utterances.spoken").otherwise("utterances.suppressed")),
        n(done, F.concat(lit("questions.by_status."), "status")),
        n(done, lit("questions.asked")),
        n(done.where("supported"), lit("questions.supported")),
        n(q.where("__asked is null"), lit("questions.not_asked")),
        n(total, lit("frames")),
        n(total.where(F.col("ms") > period_ms), lit("missed_deadlines")),
        _percentiles(times, case, "name"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
