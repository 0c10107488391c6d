"""Frames on a timeline: ordinals, gaps, bins, pairs, neighbourhoods, evenly spaced retrieval.

A frame table has one row per frame with a case key, a position inside the case (frame_index, from 1) and t_ms, whole
milliseconds from the case's start. Every window is partitioned by case and totally ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    c = F.col(ts)
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{ts}`)") * 1_000_000).cast("long")


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division."""
    return F.floor(a / b).cast("long")


def ordinals(events: DataFrame, case: str, ts: str, tie: str) -> DataFrame:
    """Adds frame_index and t_ms by (ts, tie) inside each case."""
    w = Window.partitionBy(case)
    us = micros(ts)
    return events.withColumn("frame_index", F.row_number().over(w.orderBy(ts, tie))).withColumn("__us", us).withColumn("t_ms", F.expr("(__us - min(__us) over (partition by `%s`)) div 1000" % case)).drop("__us")


def monotonic_violations(frames: DataFrame, case: str, t: str = "t_ms") -> DataFrame:
    """Frames whose time is not after the frame before (strictly)."""
    before = F.lag(t).over(Window.partitionBy(case).orderBy("frame_index"))
    return frames.withColumn("previous_ms", before).where(F.col(t) <= F.col("previous_ms")).select(case, "frame_index", t, "previous_ms")


def contiguity_gaps(rows: DataFrame, case: list[str], index: str) -> DataFrame:
    """Rows whose 1-based index differs from their position."""
    position = F.row_number().over(Window.partitionBy(*case).orderBy(index))
    return rows.withColumn("position", position).where(F.col("position") != F.col(index)).select(*case, index, "position")


def last_duration(frames: DataFrame, case: str) -> DataFrame:
    """Estimated length of each case's last frame: the interval before it; null for a case of one frame."""
    w = Window.partitionBy(case).orderBy("frame_index")
    x = frames.withColumn("duration_ms", F.col("t_ms") - F.lag("t_ms").over(w))
    return x.groupBy(case).agg(F.max("frame_index").alias("frames"), F.max_by("duration_ms", "frame_index").alias("last_duration_ms"))


def pairs(frames: DataFrame, case: str) -> DataFrame:
    """Frames two by two (the last one alone if odd), labelled with the middle time to a tenth of a second."""
    x = frames.groupBy(case, div(F.col("frame_index") - 1, 2).alias("pair")).agg(F.min("frame_index").alias("first_index"), F.max("frame_index").alias("last_index"), F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    tenths = div(F.col("a") + F.col("b") + 100, 200)
    return x.select(case, "pair", "first_index", "last_index", F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" seconds")).alias("label"))


def equal_width_bins(frames: DataFrame, case: str, bins: int) -> DataFrame:
    """Bin 0 to bins - 1 of each frame over its case's time extent; by position where there is no extent."""
    w = Window.partitionBy(case)
    low, high = F.min("t_ms").over(w), F.max("t_ms").over(w)
    by_time = div((F.col("t_ms") - low) * bins, F.nullif(high - low, F.lit(0)))
    by_place = div((F.col("frame_index") - 1) * bins, F.count(F.lit(1)).over(w))
    return frames.withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(by_time, by_place)))


def evenly_spaced(frames: DataFrame, case: str, start: Column, end: Column, k: int) -> DataFrame:
    """k frames of each case inside [start, end], both ends included, evenly by position (half-even rounding); all if fewer.

    k = 1 takes the frame nearest to the middle of the interval, the earlier of two.
    """
    inside = frames.where(F.col("t_ms").between(start, end))
    w = Window.partitionBy(case)
    x = inside.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("t_ms", "frame_index")) - 1)
    if k == 1:
        near = F.row_number().over(w.orderBy(F.abs(F.col("t_ms") * 2 - (start + end)), "t_ms", "frame_index"))
        return x.withColumn("near", near).where("near = 1").drop("n", "i", "near")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("n") - 1) / (k - 1)).cast("int"))
    return x.where((F.col("n") <= k) | F.array_contains(wanted, F.col("i").cast("int"))).drop("n", "i")


def neighbours(frames: DataFrame, case: str, value: str, k: int) -> DataFrame:
    """Values of the k frames before and after each frame, in source order."""
    w = Window.partitionBy(case).orderBy("frame_index")
    before, after = F.collect_list(value).over(w.rowsBetween(-k, -1)), F.collect_list(value).over(w.rowsBetween(1, k))
    return frames.select(case, "frame_index", F.concat(before, after).alias("neighbours"))


def context_window(frames: DataFrame, case: str, value: str, k: int) -> DataFrame:
    """Size and mean of the window of k frames on either side, the frame included."""
    w = Window.partitionBy(case).orderBy("frame_index").rowsBetween(-k, k)
    return frames.select(case, "frame_index", F.count(F.lit(1)).over(w).alias("n"), F.round(F.avg(value).over(w), 6).alias("mean_value"))


def nominal_deviation(decoded: DataFrame, case: str, fps_num: int, fps_den: int) -> DataFrame:
    """Largest distance of encoded from nominal times per case, in exact units of time base / fps.

    decoded: (case, frame_index, pts, tb_num, tb_den). Both sides are compared as whole numbers over the common
    denominator tb_den * fps_num; within is the test against min(time base, 1 / (4 fps)).
    """
    first = F.min_by("pts", "frame_index").over(Window.partitionBy(case))
    encoded = (F.col("pts") - first) * F.col("tb_num") * fps_num
    nominal = (F.col("frame_index") - 1) * F.lit(fps_den) * F.col("tb_den")
    x = decoded.withColumn("off", F.abs(encoded - nominal))
    limit = F.least(F.col("tb_num") * fps_num * 4, F.lit(fps_den) * F.col("tb_den"))  # 4 * tolerance
    x = x.withColumn("ok", F.col("off") * 4 <= limit)
    return x.groupBy(case).agg(F.max("off").alias("max_off"), F.bool_and("ok").alias("within"))
