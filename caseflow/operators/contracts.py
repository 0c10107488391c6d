"""Contracts as relational checks: each rule yields (record_id, rule_id, key, message) rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as X

VIOLATIONS = ("record_id", "rule_id", "key", "message")


def violation(rows: DataFrame, record: Column, rule: str, key: Column, message: str) -> DataFrame:
    return rows.select(record.cast("string").alias("record_id"), F.lit(rule).alias("rule_id"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def unique(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that more than one row has."""
    x = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violation(x, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), rule, F.col("n"), "key is not unique")


def references(rows: DataFrame, column: str, target: DataFrame, target_key: str, record: str, rule: str) -> DataFrame:
    """Non-null values of a column that the target does not have."""
    x = rows.where(F.col(column).isNotNull()).join(target.select(F.col(target_key).alias(column)).distinct(), column, "left_anti")
    return violation(x, F.col(record), rule, F.col(column), "unknown reference")


def rows_where(rows: DataFrame, bad: Column, record: str, rule: str, key: str, message: str) -> DataFrame:
    return violation(rows.where(F.coalesce(bad, F.lit(True))), F.col(record), rule, F.col(key), message)


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(violations: DataFrame) -> None:
    """Raises on the first violation (by rule and record), for callers who want strict loading."""
    first = violations.orderBy("rule_id", "record_id", "key").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['rule_id']}: {first[0]['record_id']}: {first[0]['message']} ({first[0]['key']})")


def leakage(rows: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """(key_kind, key, partitions): values of any key that stand in more than one partition."""
    one = rows.select(partition, F.explode(F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).cast("string").alias("key")) for k in keys])).alias("k"))
    x = one.where("k.key is not null").groupBy("k.key_kind", "k.key").agg(F.array_sort(F.collect_set(partition)).alias("partitions"))
    return x.where(F.size("partitions") > 1).select("key_kind", "key", F.array_join("partitions", ",").alias("partitions"))


def sets_differ(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one of two sets has, with side left or right."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("left")).unionByName(
        right.select(*keys).distinct().join(left.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("right"))
    )


def message_rules(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Contract of a conversation: turns from 0 without gap, known roles, user and assistant in turn, no empty text.

    A system message may only stand first. Users start, assistants end.
    """
    w = Window.partitionBy(conversation).orderBy(turn)
    x = messages.withColumn("__place", F.row_number().over(w) - 1).withColumn("__before", F.lag(role).over(w)).withColumn("__after", F.lead(role).over(w))
    r = F.col(role)
    wrong_start = F.col("__before").isNull() & ~r.isin("user", "system")
    check = lambda bad, rule, message: rows_where(x, bad, conversation, rule, turn, message)
    return all_of(
        check(F.col(turn) != F.col("__place"), "turn_gap", "turns are not 0, 1, 2, ..."),
        check(~r.isin("system", "user", "assistant"), "role", "unknown role"),
        check((r == "system") & F.coalesce(F.col("__place") > 0, F.lit(False)), "system_late", "system message after the first"),
        check(F.coalesce(r == F.col("__before"), F.lit(False)), "same_role", "two messages of one role in a row"),
        check(wrong_start, "start", "the first message is not a user's"),
        check(F.col("__after").isNull() & (r != "assistant"), "end", "the last message is not an assistant's"),
        check(F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "empty", "empty text"),
    )


def span_mismatches(claims: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Claims (key, start, end, quote) whose quote is not what stands there; offsets count code points from 0."""
    x = claims.join(texts.select(key, "text"), key, "left")
    there = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return x.where(~F.coalesce(there == F.col("quote"), F.lit(False))).select(key, "start", "end", "quote")


def uncovered(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, uncovered): non-space code points of each text outside all its half-open spans [start, end)."""
    merged = spans.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    x = texts.join(merged, key, "left")
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("rest"))

    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(acc["at"], s["start"].cast("int")), F.greatest(acc["at"], s["end"].cast("int"))
        return F.struct(end.alias("at"), F.concat(acc["rest"], F.substring(F.col("text"), acc["at"] + 1, start - acc["at"])).alias("rest"))

    folded = F.aggregate(F.coalesce("spans", F.lit([]).cast("array<struct<start:int,end:int>>")), zero, step)
    rest = F.concat(folded["rest"], F.substring(F.col("text"), folded["at"] + 1, F.length("text")))
    return x.select(key, F.length(F.regexp_replace(rest, r"\s", "")).alias("uncovered"))


def canonical(columns: list[str]) -> Column:
    """JSON of the named columns in sorted order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def restatements(messages: DataFrame, record: str, order: str, statement: str, least: float) -> DataFrame:
    """(record, order, earlier): each statement with every earlier one of its record at a similarity ratio of `least` or more.

    Statements of such a pair differ in length by a factor of (2 - least) / least at most, so that they stand in the
    same or in neighbouring length buckets: each statement is dealt to its own, each earlier one to three.
    """
    w = Window.partitionBy(record).orderBy(order, statement)
    x = messages.select(F.col(record).alias("r"), F.col(order).alias("o"), F.col(statement).alias("s"), F.row_number().over(w).alias("p")).where("s is not null")
    # the factor is taken a little larger, so that no rounding parts a pair; the empty statement is alone
    x = x.withColumn("n", F.length("s")).withColumn("b", F.when(F.col("n") > 0, F.floor(F.log("n") / math.log(1.01 * (2 - least) / least))).otherwise(-9))
    y = x.select(F.col("r").alias("r2"), F.col("o").alias("earlier"), F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("n").alias("n2"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b2"))
    near = x.join(y, F.col("r").eqNullSafe(F.col("r2")) & (F.col("b") == F.col("b2")) & (F.col("p2") < F.col("p")) & (2 * F.least("n", "n2") >= least * (F.col("n") + F.col("n2"))))
    return near.where(X.similarity_from("s", "s2", F.lit(least)).isNotNull()).select(F.col("r").alias(record), F.col("o").alias(order), "earlier")
