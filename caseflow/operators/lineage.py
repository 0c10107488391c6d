"""Whether a run was made from the selection that it names: by path, hashes, and sets of frames compared without bringing a set together.

A set's fingerprint is its size, the sum of one hash of its members and the exclusive or of another: it needs no order, tasks add up their parts, and two sets meet in an
equi-join of one row each. Sets of equal fingerprints are then verified member by member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_fingerprints(rows: DataFrame, key: str, members: list[str]) -> DataFrame:
    """(key, n, fingerprint) of each key's distinct members (a tuple of columns; nulls are values)."""
    x = rows.select(key, *members).distinct()
    # a mark for nulls, which the hash itself passes over
    marked = [y for m in members for y in (F.col(m), F.col(m).isNull())]
    both = x.select(key, F.xxhash64(F.lit(1), *marked).alias("__a"), F.xxhash64(F.lit(2), *marked).alias("__b"))
    g = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__a").cast("decimal(20,0)")).alias("__s"), F.bit_xor("__b").alias("__x"))
    return g.select(key, "n", F.concat_ws(":", F.col("n").cast("string"), F.col("__s").cast("string"), F.col("__x").cast("string")).alias("fingerprint"))


def same_sets(left: DataFrame, right: DataFrame, pairs: DataFrame, a: str, b: str, members: list[str]) -> DataFrame:
    """pairs (a, b) of which the left set of a and the right set of b are equal: by fingerprint first, then by member. A key without members is the empty set."""
    f = set_fingerprints(left, a, members).select(a, F.col("n").alias("__n"), F.col("fingerprint").alias("__f"))
    g = set_fingerprints(right, b, members).select(b, F.col("fingerprint").alias("__g"))
    x = pairs.select(a, b).distinct().join(f, a, "left").join(g, b, "left")
    empty = x.where("__f is null and __g is null").select(a, b)
    alike = x.where("__f = __g").select(a, b, "__n")
    # as many common members as the set has
    mine = left.select(a, *members).distinct()
    theirs = right.select(b, *[F.col(m).alias(f"__r_{m}") for m in members]).distinct()
    on = [F.col(m).eqNullSafe(F.col(f"__r_{m}")) for m in members]
    common = alike.join(mine, a).join(theirs.withColumnRenamed(b, "__rb"), [F.col(b) == F.col("__rb"), *on]).groupBy(a, b, "__n").agg(F.count(F.lit(1)).alias("__c"))
    return empty.unionByName(common.where("__c = __n").select(a, b))


def run_lineage(runs: DataFrame, selections: DataFrame, run_frames: DataFrame, selection_frames: DataFrame, members: list[str], targets: DataFrame, selected: DataFrame) -> DataFrame:
    """(run, path, rule_id): null where a run fits the selection at its path, else the first rule that it breaks.

    runs: (run, path, source_sha256, selection_sha256; null where none was pinned); selections: (path, source_sha256, sha256); run_frames (run, members) is the copy of the
    source that a run keeps, selection_frames (path, members) the source itself; targets (run, frame_id) what the run worked on, selected (path, frame_id) what was selected.
    Rules: unknown_selection, source, frames, selection (another version of it), no_target, target (one that was not selected).
    """
    s = selections.select("path", F.col("source_sha256").alias("__source"), F.col("sha256").alias("__sha"))
    x = runs.join(s, "path", "left")
    same = same_sets(run_frames, selection_frames, runs.select("run", "path"), "run", "path", members).withColumn("__same", F.lit(True))
    any_ = targets.select("run").distinct().withColumn("__any", F.lit(True))
    odd = targets.select("run", "frame_id").join(runs.select("run", "path"), "run").join(selected.select("path", "frame_id").distinct(), ["path", "frame_id"], "left_anti").select("run").distinct().withColumn("__odd", F.lit(True))
    x = x.join(same, ["run", "path"], "left").join(any_, "run", "left").join(odd, "run", "left")
    rule = F.when(F.col("__sha").isNull(), "unknown_selection").when(~F.col("source_sha256").eqNullSafe(F.col("__source")), "source").when(F.col("__same").isNull(), "frames")
    rule = rule.when(F.col("selection_sha256").isNotNull() & (F.col("selection_sha256") != F.col("__sha")), "selection").when(F.col("__any").isNull(), "no_target").when(F.col("__odd"), "target")
    return x.select("run", "path", rule.alias("rule_id"))
