"""Training-row exports: messages projection, canonical hashes, receipts, verified loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"


def message_rows(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, messages): one portable row per conversation, turns in order, text content only."""
    content = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), F.lit(None).cast("string").alias("image")))
    item = F.struct(F.col(turn).alias("turn"), F.struct(F.col(role).alias("role"), content.alias("content")).alias("m"))
    x = messages.groupBy(conversation).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return x.select(conversation, F.transform("items", lambda i: i["m"]).alias("messages"))


def portable(messages: Column) -> Column:
    """Roles alternate user, assistant, ... in whole pairs (after at most one system message), every content non-empty."""
    first = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    rest = F.when(first, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    turns = F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    filled = F.forall(messages, lambda m: F.size(m["content"]) > 0)
    return (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & F.forall(turns, lambda t: t) & filled


def row_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def receipt(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row: number of rows, and the hash of all row hashes in the order of their keys.

    The hashes are combined per bucket of keys first, so that no task holds the whole list of a large export.
    """
    x = rows.select(F.col(key).alias("k"), row_hash(F.col(text)).alias("h"))
    per = x.groupBy(F.floor(F.col("k") / 1000).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ""), 256).alias("h"))
    return per.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256).alias("rows_sha256"))


def export(rows: DataFrame, path: str, key: str) -> None:
    """Writes the messages as JSON lines with row hashes and a receipt; the path must not exist."""
    x = rows.withColumn("row_json", F.to_json("messages", {"ignoreNullFields": "true"})).withColumn("row_sha256", row_hash(F.col("row_json")))
    x.select(key, "messages", "row_sha256").write.mode("errorifexists").json(f"{path}/rows")
    receipt(x, key, "row_json").write.mode("errorifexists").json(f"{path}/receipt")


def load(spark: SparkSession, path: str, key: str, key_type: str = "bigint") -> DataFrame:
    """Rows of an export, after their hashes and the receipt agree; raises ValueError else."""
    x = spark.read.schema(f"{key} {key_type}, messages {MESSAGES}, row_sha256 string").json(f"{path}/rows")
    x = x.withColumn("row_json", F.to_json("messages", {"ignoreNullFields": "true"}))
    if x.where(~F.coalesce(row_hash(F.col("row_json")) == F.col("row_sha256"), F.lit(False))).limit(1).count():
        raise ValueError("a row's hash differs")
    told = spark.read.schema("rows bigint, rows_sha256 string").json(f"{path}/receipt").first()
    if told != receipt(x, key, "row_json").first():
        raise ValueError("the receipt differs")
    return x.select(key, "messages")
