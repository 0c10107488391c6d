"""Recovery of withheld moments over rounds of review: what was asked for, what came back, what was kept, and what it cost.

A run has members (run, moment_id, frame_id, t_ms), the frames of each moment; supplied (run, frame_id); searches (run, round, search, start_ms, end_ms);
retrieved (run, round, search, frame_id, t_ms); decisions (run, round, frame_id, t_ms, decision). Moments of which nothing was supplied are its gaps.
A frame that is no member counts for a moment only as a proxy: near an anchor of it, and of no other. Too broad a search earns no credit for asking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.intervals import union_length


def missing_moments(members: DataFrame, supplied: DataFrame) -> DataFrame:
    """(run, moment_id) of moments of which no frame was supplied."""
    there = members.join(supplied.select("run", "frame_id").distinct(), ["run", "frame_id"], "left_semi").select("run", "moment_id").distinct()
    return members.select("run", "moment_id").distinct().join(there, ["run", "moment_id"], "left_anti")


def matched(frames: DataFrame, members: DataFrame, tolerance: int) -> DataFrame:
    """frames (run, frame_id, t_ms, ...) with match_kind and moment_ids.

    exact_reference_member; temporal_proxy (within the tolerance of one moment's anchors); ambiguous_temporal_proxy (of several);
    outside_reference_needs_review. Anchors are met by cells of the tolerance's width, a frame's own and the two beside it.
    """
    width = max(1, tolerance)
    cell = lambda c: F.floor(F.col(c) / width)
    own = members.groupBy("run", "frame_id").agg(F.min("moment_id").alias("__exact"))
    wide = frames.select("run", "frame_id", "t_ms").distinct().withColumn("__cell", F.explode(F.sequence(cell("t_ms") - 1, cell("t_ms") + 1)))
    anchors = members.select("run", "moment_id", F.col("t_ms").alias("__anchor")).distinct().withColumn("__cell", cell("__anchor"))
    near = wide.join(anchors, ["run", "__cell"]).where(F.abs(F.col("t_ms") - F.col("__anchor")) <= tolerance).groupBy("run", "frame_id", "t_ms").agg(F.array_sort(F.collect_set("moment_id")).alias("__near"))
    x = frames.join(own, ["run", "frame_id"], "left").join(near, ["run", "frame_id", "t_ms"], "left")
    n = F.coalesce(F.size("__near"), F.lit(0))
    kind = F.when(F.col("__exact").isNotNull(), "exact_reference_member").when(n == 1, "temporal_proxy").when(n > 1, "ambiguous_temporal_proxy").otherwise("outside_reference_needs_review")
    ids = F.when(F.col("__exact").isNotNull(), F.array("__exact")).otherwise(F.coalesce("__near", F.array().cast(members.select(F.array("moment_id")).schema[0].dataType)))
    return x.withColumn("match_kind", kind).withColumn("moment_ids", ids).drop("__exact", "__near")


def asked(searches: DataFrame, members: DataFrame, missing: DataFrame, tolerance: int, duration: Column, most: int) -> DataFrame:
    """(run, round, search, moment_id): gaps of which an anchor, give or take the tolerance and within the recording, meets a search of at most `most` ms."""
    a = members.join(missing, ["run", "moment_id"], "left_semi").select("run", "moment_id", F.col("t_ms").alias("__anchor")).distinct()
    meets = (F.col("start_ms") <= F.least(duration, F.col("__anchor") + tolerance)) & (F.col("end_ms") >= F.greatest(F.lit(0), F.col("__anchor") - tolerance))
    ok = searches.where(F.col("end_ms") - F.col("start_ms") <= most)
    return ok.join(a, "run").where(meets).select("run", "round", "search", "moment_id").distinct()


def _credited(frames: DataFrame, missing: DataFrame) -> DataFrame:
    """(run, round, moment_id, kind) of frames that stand for a gap."""
    x = frames.where(F.col("match_kind").isin("exact_reference_member", "temporal_proxy")).select("run", "round", "match_kind", F.explode("moment_ids").alias("moment_id"))
    kind = F.when(F.col("match_kind") == "exact_reference_member", "exact").otherwise("temporal_proxy")
    return x.join(missing, ["run", "moment_id"], "left_semi").select("run", "round", "moment_id", kind.alias("kind")).distinct()


def rates(runs: DataFrame, members: DataFrame, supplied: DataFrame, searches: DataFrame, retrieved: DataFrame, decisions: DataFrame, tolerance: int, duration: Column, most: int = 10_000) -> DataFrame:
    """(run, stage, count, denominator, recall) of each run (run): its gaps that each stage has found; recall is null where there are none.

    initial_requested (by the first round), cumulative_requested, cumulative_retrieved, final_retained (kept by the last round), the last two also _exact and _temporal_proxy.
    """
    missing = missing_moments(members, supplied)
    ask = asked(searches, members, missing, tolerance, duration, most)
    rounds = decisions.select("run", "round").union(searches.select("run", "round")).groupBy("run").agg(F.min("round").alias("__first"), F.max("round").alias("__last"))
    back = _credited(matched(retrieved, members, tolerance), missing)
    kept = _credited(matched(decisions.join(rounds, "run").where("round = __last and decision = 'keep'"), members, tolerance), missing)
    of = lambda df, stage: df.select("run", F.lit(stage).alias("stage"), "moment_id")
    found = of(ask.join(rounds, "run").where("round = __first"), "initial_requested").unionByName(of(ask, "cumulative_requested"))
    for stage, df in (("cumulative_retrieved", back), ("final_retained", kept)):
        found = found.unionByName(of(df, stage)).unionByName(df.select("run", F.concat_ws("_", F.lit(stage), "kind").alias("stage"), "moment_id"))
    stages = ["initial_requested", "cumulative_requested", *(f"{s}{k}" for s in ("cumulative_retrieved", "final_retained") for k in ("", "_exact", "_temporal_proxy"))]
    n = found.groupBy("run", "stage").agg(F.count_distinct("moment_id").alias("__n"))
    whole = runs.select("run").distinct().join(missing.groupBy("run").agg(F.count(F.lit(1)).alias("__d")), "run", "left").withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    x = whole.join(n, ["run", "stage"], "left")
    count, out_of = F.coalesce("__n", F.lit(0)), F.coalesce("__d", F.lit(0))
    return x.select("run", "stage", count.alias("count"), out_of.alias("denominator"), F.when(out_of > 0, count / out_of).alias("recall"))


def progress(members: DataFrame, supplied: DataFrame, searches: DataFrame, retrieved: DataFrame, decisions: DataFrame, tolerance: int, duration: Column, most: int = 10_000) -> DataFrame:
    """(run, round, requested, retrieved): how many gaps were asked for, and had come back, by the end of each round."""
    missing = missing_moments(members, supplied)
    ask = asked(searches, members, missing, tolerance, duration, most)
    back = _credited(matched(retrieved, members, tolerance), missing)
    first = lambda df, name: df.groupBy("run", "moment_id").agg(F.min("round").alias("round")).groupBy("run", "round").agg(F.count(F.lit(1)).alias(name))
    rounds = decisions.select("run", "round").union(searches.select("run", "round")).distinct()
    x = rounds.join(first(ask, "__a"), ["run", "round"], "left").join(first(back, "__b"), ["run", "round"], "left")
    w = Window.partitionBy("run").orderBy("round")
    so_far = lambda c, name: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name)
    return x.select("run", "round", so_far("__a", "requested"), so_far("__b", "retrieved"))


def cost(runs: DataFrame, searches: DataFrame, retrieved: DataFrame, most: int = 10_000) -> DataFrame:
    """(run, requests, broad, summed_ms, union_ms, returned, returned_distinct) of each run, zeros where nothing was asked."""
    span = F.col("end_ms") - F.col("start_ms")
    a = searches.groupBy("run").agg(F.count(F.lit(1)).alias("requests"), F.count_if(span > most).alias("broad"), F.sum(span).alias("summed_ms"))
    u = union_length(searches, ["run"], "start_ms", "end_ms").select("run", F.col("covered").alias("union_ms"))
    r = retrieved.groupBy("run").agg(F.count(F.lit(1)).alias("returned"), F.count_distinct("frame_id").alias("returned_distinct"))
    return runs.select("run").distinct().join(a, "run", "left").join(u, "run", "left").join(r, "run", "left").na.fill(0)


def session_violations(supplied: DataFrame, searches: DataFrame, retrieved: DataFrame, decisions: DataFrame, duration: Column) -> DataFrame:
    """(run, round, rule_id, frame_id): interval (start < end within the recording), decision (neither keep nor drop), not_supplied (a decision on a frame that the
    run did not have by then), undecided (a round that leaves frames out; without frame), repeated (a frame comes back that was there), outside (not in its search's interval).
    """
    none = F.lit(None).cast(supplied.schema["frame_id"].dataType)
    had = supplied.select("run", "frame_id", F.lit(-1).alias("round")).union(retrieved.select("run", "frame_id", "round")).groupBy("run", "frame_id").agg(F.min("round").alias("__since"))
    of = lambda df, rule, frame=F.col("frame_id"): df.select("run", "round", F.lit(rule).alias("rule_id"), frame.alias("frame_id"))
    bad = searches.where(~F.coalesce((F.col("start_ms") < F.col("end_ms")) & (F.col("start_ms") >= 0) & (F.col("end_ms") <= duration), F.lit(False)))
    judged = decisions.join(had, ["run", "frame_id"], "left").withColumn("__ok", F.coalesce(F.col("__since") < F.col("round"), F.lit(False)))
    rounds = decisions.groupBy("run", "round").agg(F.count(F.lit(1)).alias("__all"))
    known = judged.where("__ok").select("run", "round", "frame_id").distinct().groupBy("run", "round").agg(F.count(F.lit(1)).alias("__n"))
    due = rounds.select("run", "round").join(had, "run").where("__since < round").groupBy("run", "round").agg(F.count(F.lit(1)).alias("__due"))
    left = due.join(known, ["run", "round"], "left").where(F.col("__due") > F.coalesce("__n", F.lit(0)))
    again = F.row_number().over(Window.partitionBy("run", "frame_id").orderBy("round", "search")) > 1
    twice = retrieved.withColumn("__again", again).join(supplied.select("run", "frame_id", F.lit(True).alias("__own")).distinct(), ["run", "frame_id"], "left").where("__again or __own")
    placed = retrieved.join(searches, ["run", "round", "search"], "left").where(~F.coalesce(F.col("t_ms").between(F.col("start_ms"), F.col("end_ms")), F.lit(False)))
    parts = [of(bad, "interval", none), of(decisions.where(~F.coalesce(F.col("decision").isin("keep", "drop"), F.lit(False))), "decision"), of(judged.where("not __ok"), "not_supplied"), of(left, "undecided", none), of(twice, "repeated"), of(placed, "outside")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
