"""Questions about a moment, answered from the event log alone, and their grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES = ("visible_now", "first_seen", "entry_count", "near_now", "time_in_view", "last_left")


def answers(questions: DataFrame, log: DataFrame) -> DataFrame:
    """(case_id, question_id, template, answer): JSON text of the answer, null where there is none.

    questions: (case_id, question_id, template, label, at_ms); log: (case_id, label, type, t_ms, onset_ms, seq) of
    entered, left, near and clear events. Only events with t_ms <= at_ms count. Times are onsets in seconds;
    time_in_view is the time since the last entry, 0 for what is not in view. An exit also ends near.
    """
    seen = questions.select("case_id", "question_id", "at_ms").join(log, "case_id").where(F.col("t_ms") <= F.col("at_ms"))
    entered, left = F.col("type") == "entered", F.col("type") == "left"
    per = seen.groupBy("case_id", "question_id", "label").agg(
        F.max_by("type", F.when(F.col("type").isin("entered", "left"), F.col("seq"))).alias("last"),
        F.max_by("type", F.when(F.col("type").isin("near", "clear", "left"), F.col("seq"))).alias("last_near"),
        F.min(F.when(entered, F.col("onset_ms"))).alias("first_ms"),
        F.max(F.when(entered, F.col("onset_ms"))).alias("entry_ms"),
        F.max(F.when(left, F.col("onset_ms"))).alias("left_ms"),
        F.count_if(entered).alias("entries"),
    )
    view = per.groupBy("case_id", "question_id").agg(F.array_sort(F.collect_list(F.when(F.col("last") == "entered", F.col("label")))).alias("visible"), F.coalesce(F.bool_or(F.col("last_near") == "near"), F.lit(False)).alias("near"))
    x = questions.join(view, ["case_id", "question_id"], "left").join(per, ["case_id", "question_id", "label"], "left")
    seconds = lambda ms: F.round(ms / 1000, 3).cast("string")
    in_view = F.when(F.col("last") == "entered", F.col("at_ms") - F.col("entry_ms")).otherwise(0)
    answer = (
        F.when(F.col("template") == "visible_now", F.to_json(F.coalesce("visible", F.lit([]).cast("array<string>"))))
        .when(F.col("template") == "first_seen", seconds(F.col("first_ms")))
        .when(F.col("template") == "entry_count", F.coalesce("entries", F.lit(0)).cast("string"))
        .when(F.col("template") == "near_now", F.coalesce("near", F.lit(False)).cast("string"))
        .when(F.col("template") == "time_in_view", seconds(F.coalesce(in_view, F.lit(0))))
        .when(F.col("template") == "last_left", seconds(F.col("left_ms")))
    )
    return x.select("case_id", "question_id", "template", answer.alias("answer"))


def grade(truth: DataFrame, given: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """(case_id, question_id, template, status, correct): missing, or right or wrong.

    Lists compare as sets, booleans leniently, times within the tolerance, counts exactly, null with null only.
    """
    x = truth.withColumnRenamed("answer", "truth").join(given.select("case_id", "question_id", F.col("answer").alias("given"), F.lit(True).alias("there")), ["case_id", "question_id"], "left")
    as_set = lambda c: F.array_sort(F.array_distinct(F.transform(F.from_json(c, "array<string>"), lambda v: F.lower(F.trim(v)))))
    number = lambda c: F.nullif(F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    same = (
        F.when(F.col("truth").isNull(), F.col("given").isNull())
        .when(F.col("template") == "visible_now", as_set("truth") == as_set("given"))
        .when(F.col("template") == "near_now", F.col("truth") == F.when(F.lower(F.trim("given")).isin("true", "yes"), "true").when(F.lower(F.trim("given")).isin("false", "no"), "false"))
        .when(F.col("template") == "entry_count", number("truth") == number("given"))
        .otherwise(F.abs(number("truth") - number("given")) <= tolerance_s)
    )
    correct: Column = F.coalesce(F.col("there") & same, F.lit(False))
    return x.select("case_id", "question_id", "template", F.when(F.col("there").isNull(), "missing").when(correct, "right").otherwise("wrong").alias("status"), correct.alias("correct"))
