"""Provenance: manifests, inventories, exposure of generated claims, release indices, ordered stream comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.contracts import VIOLATIONS, all_of, violation
from caseflow.operators.graph import closure, reachable


def manifest_violations(frames: DataFrame, source: str) -> DataFrame:
    """Frames of a source manifest (frame_index from 0, timestamp_ms, width, height) that break it: ordinals without gap,
    strictly rising finite times, one size."""
    w = Window.partitionBy(source).orderBy("frame_index")
    x = frames.withColumn("__place", F.row_number().over(w) - 1).withColumn("__before", F.lag("timestamp_ms").over(w)).withColumn("__size", F.first(F.struct("width", "height")).over(w))
    t = F.col("timestamp_ms")
    check = lambda bad, rule, message: violation(x.where(F.coalesce(bad, F.lit(True))), F.col(source), rule, F.col("frame_index"), message)
    return all_of(
        check(F.col("frame_index") != F.col("__place"), "ordinal", "frame index is not its position"),
        check(t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")), "finite", "time is not a finite number"),
        check(F.col("__before").isNotNull() & (t <= F.col("__before")), "rising", "time does not rise"),
        check(~F.struct("width", "height").eqNullSafe(F.col("__size")), "size", "size changes"),
    ).select(*VIOLATIONS)


def asset_conflicts(assets: DataFrame, path: str, digest: str) -> DataFrame:
    """Paths for which more than one digest is stated."""
    x = assets.groupBy(path).agg(F.array_sort(F.collect_set(digest)).alias("digests"))
    return x.where(F.size("digests") > 1)


def inventory_diff(stated: DataFrame, found: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, status): missing, extra or changed files of an inventory."""
    a, b = stated.select(path, F.col(digest).alias("a")), found.select(path, F.col(digest).alias("b"))
    x = a.join(b, path, "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return x.select(path, status.alias("status")).where("status is not null")


def first_mismatch(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str, digest: str) -> DataFrame:
    """(keys, ordinal): the first position at which two ordered streams differ, one of them ending included; no row if equal."""
    a = left.select(*keys, ordinal, F.col(digest).alias("__a"))
    b = right.select(*keys, ordinal, F.col(digest).alias("__b"))
    x = a.join(b, [*keys, ordinal], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return x.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))


def exposure(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """(run_id, max_frame, saw_outcome): what each run has seen, its ancestors' inputs included.

    runs: (run_id, frame_index, outcome boolean), a row per input; parents: (run_id, parent_id). Walks from every run
    at once, so rounds grow with the logarithm of the lineage's depth.
    """
    pairs = parents.select("run_id", "parent_id").where("parent_id is not null")
    nodes = runs.select("run_id").union(pairs.select("run_id")).distinct()
    up = closure(pairs.select(F.col("run_id").alias("src"), F.col("parent_id").alias("dst")))
    seen = nodes.select("run_id", F.col("run_id").alias("from_run")).union(up.select(F.col("src").alias("run_id"), F.col("dst").alias("from_run"))).distinct()
    x = seen.join(runs.withColumnRenamed("run_id", "from_run"), "from_run")
    return x.groupBy("run_id").agg(F.max("frame_index").alias("max_frame"), F.bool_or("outcome").alias("saw_outcome"))


def exposure_violations(claims: DataFrame, seen: DataFrame) -> DataFrame:
    """Claims (claim_id, run_id, cutoff_index, causal) whose run saw frames after the cutoff or, if causal, outcomes."""
    x = claims.join(seen, "run_id")
    return all_of(
        violation(x.where("max_frame > cutoff_index"), F.col("claim_id"), "future_frame", F.col("max_frame"), "the run saw a later frame"),
        violation(x.where("causal and saw_outcome"), F.col("claim_id"), "outcome", F.col("run_id"), "the run saw outcomes"),
    )


def hidden_assets(hidden: DataFrame, derived: DataFrame) -> DataFrame:
    """(node, depth): hidden assets (node) and all that is derived from them. derived: (asset_id, from_id)."""
    return reachable(hidden, derived.select(F.col("from_id").alias("src"), F.col("asset_id").alias("dst")))


def release_index(receipts: DataFrame) -> DataFrame:
    """(key, partition): partition of each released key by the first receipt (receipt_path, key, partition) that has it."""
    return receipts.groupBy("key").agg(F.min_by("partition", "receipt_path").alias("partition"))


def release_conflicts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (key, partition) that an earlier release put into another partition."""
    return rows.join(index.withColumnRenamed("partition", "released"), "key").where("partition != released")


def turn_violations(turns: DataFrame, cites: DataFrame, record: str) -> DataFrame:
    """Causal rules of conversation turns (turn, cutoff_index) and their cited frames (turn, frame_index): cutoffs do not
    fall, no citation lies after its turn's cutoff."""
    w = Window.partitionBy(record).orderBy("turn")
    falling = turns.withColumn("__before", F.lag("cutoff_index").over(w)).where("cutoff_index < __before")
    late = cites.join(turns, [record, "turn"]).where("frame_index > cutoff_index")
    return all_of(violation(falling, F.col(record), "cutoff", F.col("turn"), "the cutoff falls"), violation(late, F.col(record), "future", F.col("frame_index"), "cites a frame after the cutoff"))
