"""Hysteresis, view, dwell and proximity detectors as exact window forms (no Python, no state).

All of them: mark a trigger on each row, then keep a row whose trigger differs from the last trigger before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def run_length(rows: DataFrame, keys: list[str], order: str, same: str) -> DataFrame:
    """Adds r: how many rows up to this one have had the same value of `same` (null is a value)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    x = rows.withColumn("__change", changed).withColumn("__island", F.sum("__change").over(w))
    return x.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(order))).drop("__change", "__island")


def changes(rows: DataFrame, keys: list[str], order: str, trigger: str, initial: str) -> DataFrame:
    """Rows whose non-null trigger differs from the last non-null one before, at first `initial`."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.coalesce(F.last(trigger, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(initial))
    return rows.withColumn("__last", last).where(F.col(trigger).isNotNull() & (F.col(trigger) != F.col("__last"))).drop("__last")


def _earlier(value: str, w: WindowSpec, n: int) -> Column:
    return F.lag(value, n - 1).over(w) if n > 1 else F.col(value)


def presence(observations: DataFrame, case: str, order: str, t: str, labels: str) -> DataFrame:
    """(case, order, t, label, present) for each label that a case ever has and each of its observed rows.

    labels: array of the labels that are confidently seen. The number of labels is that of the vocabulary.
    """
    known = observations.select(case, F.explode(labels).alias("label")).distinct()
    return observations.select(case, order, t, labels).join(known, case).select(case, order, t, "label", F.array_contains(labels, F.col("label")).alias("present"))


def hysteresis(seen: DataFrame, case: str, order: str, t: str, enter: int, leave: int) -> DataFrame:
    """Entries and exits: `enter` consecutive presences, `leave` consecutive absences; onset is the first of them.

    seen: as from presence(). Returns (case, label, type, order, t, onset_ms).
    """
    keys = [case, "label"]
    w = Window.partitionBy(*keys).orderBy(order)
    x = run_length(seen, keys, order, "present")
    x = x.withColumn("type", F.when(F.col("present") & (F.col("r") >= enter), "entered").when(~F.col("present") & (F.col("r") >= leave), "left"))
    x = x.withColumn("onset_ms", F.when(F.col("present"), _earlier(t, w, enter)).otherwise(_earlier(t, w, leave)))
    return changes(x, keys, order, "type", "left").select(case, "label", "type", order, t, "onset_ms")


def view_runs(observations: DataFrame, case: str, order: str, t: str, any_seen: Column, empty: int) -> DataFrame:
    """view_empty after `empty` rows without any detection, view_restored at the first with one."""
    w = Window.partitionBy(case).orderBy(order)
    x = run_length(observations.withColumn("__any", any_seen), [case], order, "__any")
    x = x.withColumn("type", F.when(F.col("__any"), "view_restored").when(F.col("r") >= empty, "view_empty"))
    x = x.withColumn("onset_ms", F.when(F.col("__any"), F.col(t)).otherwise(_earlier(t, w, empty)))
    return changes(x, [case], order, "type", "view_restored").select(case, "type", order, t, "onset_ms")


def dwell(rows: DataFrame, case: str, order: str, t: str, candidate: str, frames: int, initial: str) -> DataFrame:
    """A step is entered when its candidate holds for `frames` rows; null never does."""
    x = run_length(rows, [case], order, candidate)
    x = x.withColumn("step", F.when(F.col(candidate).isNotNull() & (F.col("r") >= frames), F.col(candidate)))
    return changes(x, [case], order, "step", initial).select(case, "step", order, t)


def step_checks(steps: DataFrame, case: str, order: str, allowed: dict[str, list[str]], expected: list[str], initial: str) -> DataFrame:
    """Adds from_step, legal (an allowed transition) and skipped (an earlier expected step was never entered)."""
    w = Window.partitionBy(case).orderBy(order)
    x = steps.withColumn("from_step", F.coalesce(F.lag("step").over(w), F.lit(initial)))
    table = F.create_map(*[y for k, v in sorted(allowed.items()) for y in (F.lit(k), F.array(*[F.lit(z) for z in v]))])
    x = x.withColumn("legal", F.coalesce(F.array_contains(F.element_at(table, F.col("from_step")), F.col("step")), F.lit(False)))
    visited = F.collect_set("step").over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = F.create_map(*[y for i, s in enumerate(expected) for y in (F.lit(s), F.array(*[F.lit(z) for z in expected[:i]]) if i else F.lit([]).cast("array<string>"))])
    return x.withColumn("skipped", F.size(F.array_except(F.coalesce(F.element_at(before, F.col("step")), F.lit([]).cast("array<string>")), visited)) > 0)


def proximity(rows: DataFrame, keys: list[str], order: str, t: str, near: float, clear_factor: float, frames: int) -> DataFrame:
    """near after `frames` visited rows within `near`, clear once the distance exceeds near * clear_factor.

    rows: (keys, order, t, instrument, structure, distance): only rows with instrument are visited; a row without
    structure ends a run. Onset is the run's first row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = rows.where("instrument").withColumn("__close", F.col("structure") & F.coalesce(F.col("distance") <= near, F.lit(False)))
    x = run_length(x, keys, order, "__close")
    x = x.withColumn("type", F.when(F.col("__close") & (F.col("r") >= frames), "near").when(F.col("structure") & (F.col("distance") > near * clear_factor), "clear"))
    x = x.withColumn("onset_ms", F.when(F.col("__close"), _earlier(t, w, frames)).otherwise(F.col(t)))
    return changes(x, keys, order, "type", "clear").select(*keys, "type", order, t, "onset_ms", "distance")
