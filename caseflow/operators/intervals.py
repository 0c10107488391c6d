"""Interval operators: bucketed band and overlap joins, union length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """Pairs of equal keys with |x - y| <= tolerance.

    A plain band condition would be a nested loop. Both sides get buckets one tolerance wide; a right row goes to its
    bucket and the two beside it, so the join is an equi-join and every pair meets exactly once.
    """
    width = tolerance if tolerance > 0 else 1
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    lo = left.withColumn("__bucket", bucket(x))
    r = right.withColumn("__bucket", F.explode(F.array(*[bucket(y) + d for d in (-1, 0, 1)])))
    return lo.join(r, [*keys, "__bucket"]).where(F.abs(F.col(x) - F.col(y)) <= tolerance).drop("__bucket")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of equal keys whose closed intervals share a point, each once.

    Intervals are dealt to all buckets of `width` that they touch; a pair is taken in the bucket where the later of
    both starts lies, which both touch.
    """
    deal = lambda df, s, e: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(s) / width).cast("long"), F.floor(F.col(e) / width).cast("long"))))
    x = deal(left.where(F.col(a[0]) <= F.col(a[1])), *a).join(deal(right.where(F.col(b[0]) <= F.col(b[1])), *b), [*keys, "__bucket"])
    later = F.greatest(F.col(a[0]), F.col(b[0]))
    return x.where((later <= F.least(F.col(a[1]), F.col(b[1]))) & (F.col("__bucket") == F.floor(later / width).cast("long"))).drop("__bucket")


def union_length(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, summed, covered): total length of the intervals and of their union."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0).cast("long"), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    x = intervals.withColumn("__new", new)
    return x.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("summed"), F.sum("__new").alias("covered"))


def anchor_matches(frames: DataFrame, anchors: DataFrame, keys: list[str], t: str, anchor: str, moment: str, tolerance: float) -> DataFrame:
    """match_kind of each frame against the moments' anchors: exact, single, ambiguous or outside; moment if one fits."""
    hit = band_join(frames.select(*keys, "frame_id", t), anchors.select(*keys, moment, anchor), keys, t, anchor, tolerance)
    hit = hit.groupBy(*keys, "frame_id").agg(F.count_distinct(moment).alias("n"), F.min(moment).alias("m"), F.bool_or(F.col(t) == F.col(anchor)).alias("exact"))
    kind = F.when(F.col("n").isNull(), "outside").when(F.col("n") > 1, "ambiguous").when(F.col("exact"), "exact").otherwise("single")
    return frames.join(hit, [*keys, "frame_id"], "left").select(*keys, "frame_id", kind.alias("match_kind"), F.when(F.col("n") == 1, F.col("m")).alias(moment))


def rate(hit: Column, total: Column) -> Column:
    """hit / total, null for an empty total."""
    return F.round(hit / F.nullif(total, F.lit(0)), 6)
