"""Event log: causal queries, as-of state and joins, rule matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators import fold


def causal_query(log: DataFrame, case: str, now: Column, types: list[str] | None = None, subject: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = 50) -> DataFrame:
    """The last `limit` events of each case with t_ms <= min(now, until), by (t_ms, event_id); the future never shows."""
    x = log.where(F.col("t_ms") <= (now if until is None else F.least(now, until)))
    if types is not None:
        x = x.where(F.col("type").isin(types))
    if since is not None:
        x = x.where(F.col("t_ms") >= since)
    if subject is not None:
        x = x.where((F.col("subject") == subject) | F.coalesce(F.col("object") == subject, F.lit(False)))
    return recent(x, case, limit)


def recent(rows: DataFrame, case: str, n: int) -> DataFrame:
    """The n latest rows of each case."""
    place = F.row_number().over(Window.partitionBy(case).orderBy(F.desc("t_ms"), F.desc("event_id")))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def state_at(triggers: DataFrame, keys: list[str], now: Column, order: str, opener: str) -> DataFrame:
    """Keys whose last trigger at or before `now` opens: (keys, since_ms)."""
    x = triggers.where(F.col("t_ms") <= now).groupBy(*keys).agg(F.max_by(F.struct("type", "t_ms"), order).alias("l"))
    return x.where(F.col("l.type") == opener).select(*keys, F.col("l.t_ms").alias("since_ms"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, t: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key at or before its time; of equal times the greater value struct.

    A union and one window by key: each side is shuffled once, whatever the match distance.
    """
    r = right.select(key, t, F.struct(t, *values).alias("__r"), F.lit(0).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(f"__l_{c}") for c in left.columns])
    own = left.select(key, t, F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__l_{c}") for c in left.columns])
    w = Window.partitionBy(key).orderBy(t, "__side", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    x = r.unionByName(own).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return x.select(*[F.col(f"__l_{c}").alias(c) for c in left.columns], F.col(f"__m.{t}").alias(f"matched_{t}"), *[F.col(f"__m.{v}").alias(f"matched_{v}") for v in values])


def first_due(questions: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """The first frame of each question's case at or after its at_ms (forward as-of); null if the case ends before.

    A union and one window by case, as in asof_backward: questions stand before the frames of their time and look ahead.
    """
    f = frames.where("t_ms is not null").select(key, F.col("t_ms").alias("__t"), F.lit(1).alias("__side"), F.struct("t_ms", "frame_index").alias("__d"))
    q = questions.select(key, F.col("at_ms").alias("__t"), F.lit(0).alias("__side"), "question_id", "at_ms")
    w = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__side"), F.desc("__d")).rowsBetween(Window.unboundedPreceding, 0)
    x = f.unionByName(q, allowMissingColumns=True).withColumn("__due", F.last("__d", ignorenulls=True).over(w)).where("__side = 0")
    return x.select(key, "question_id", "at_ms", F.col("__due.frame_index").alias("due_index"), F.col("__due.t_ms").alias("due_ms"))


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events and the rules that they meet: equal type, subject and object as wildcards where null, and the state.

    events has `visible`, the labels in view; rules are a small table by construction (type, subject, object,
    present, absent, rule_id, priority), joined on type, so that the wildcards are tested inside an equi-join.
    """
    r = rules.alias("r")
    e = events.alias("e")
    wild = lambda c: F.col(f"r.{c}").isNull() | (F.col(f"r.{c}") == F.col(f"e.{c}"))
    state = (F.size(F.array_except("r.present", "e.visible")) == 0) & ~F.arrays_overlap("r.absent", "e.visible")
    return e.join(r, (F.col("r.type") == F.col("e.type")) & wild("subject") & wild("object") & state).select("e.*", "r.rule_id", "r.priority")


class _Said:
    """What later candidates of a case can still see: when each key was last spoken, and what was spoken unasked within the last minute."""

    def __init__(self) -> None:
        self.last: dict = {}
        self.minute: list[int] = []


def gate(candidates: DataFrame, case: str, order: list[str], stale_ms: int, least_confidence: float, cooldown_ms: int, per_minute: int) -> DataFrame:
    """Decision of each candidate in order: answers pass, and take nothing from the minute's budget; stale; low_confidence; cooldown; rate_limited; spoken.

    Only spoken candidates feed later decisions, so a case's candidates are one pass in order; they stream through their task, see fold.
    candidates: (case, t_ms, now_ms, key, priority, confidence, is_answer, *order). Returns case, order, decision.
    """

    def step(said: _Said, c: dict) -> tuple:
        now, key = c["now_ms"], c["key"]
        said.minute = [t for t in said.minute if now - t < 60_000]
        before = said.last.get(key)
        if not c["is_answer"]:
            if now - c["t_ms"] > stale_ms:
                return ("stale",)
            if c["confidence"] < least_confidence:
                return ("low_confidence",)
            if before is not None and now - before < cooldown_ms:
                return ("cooldown",)
            if c["priority"] != "critical" and len(said.minute) >= per_minute:
                return ("rate_limited",)
            said.minute.append(now)
        said.last[key] = now
        return ("spoken",)

    reads = ["t_ms", "now_ms", "key", "priority", "confidence", "is_answer"]
    return fold.scan(candidates.select(case, *order, *[c for c in reads if c not in order]), [case], order, reads, _Said, step, "decision string").select(case, *order, "decision")


def visible_after(triggers: DataFrame, case: str, order: str, label: str, type_: str, opener: str) -> DataFrame:
    """(case, order, visible): the labels that are open once all triggers at a place are in, for each place that has any; one pass by case."""
    steps = triggers.groupBy(case, order).agg(F.map_from_entries(F.collect_list(F.struct(label, type_))).alias("__m"))

    def step(open_: set, row: dict) -> tuple:
        for name, kind in row["__m"]:
            (open_.add if kind == opener else open_.discard)(name)
        return (sorted(open_),)

    return fold.scan(steps, [case], [order], ["__m"], set, step, "visible array<string>").drop("__m")
