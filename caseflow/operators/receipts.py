"""Exports with receipts: a tree of hashes over all rows, folded in rounds, that leads from a changed root to the changed row.

A row's leaf is the hash of its key, its text's hash and how often both occur. Leaves are gathered by the first digits of their key's hash, so that a
node has at most 16 children, and a bucket at the bottom some 16 leaves whatever the export's size; a key that repeats is one leaf a text. No row and no
task ever holds the hashes of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators.exports import MESSAGES, portable

#: Leaves that a bucket at the bottom holds on average, at most.
BUCKET = 16
SUMMARY = "purpose string, partition string, loss_scope string, intended_use string, row_count long, depth int, root_sha256 string"


def depth_for(rows: int) -> int:
    """Rounds of folding by 16 that leave some BUCKET leaves in each bucket."""
    return max(0, math.ceil(math.log(rows / BUCKET, 16))) if rows > BUCKET else 0


def leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_sha256, n, at, leaf): a row for each key and text; at: the hash of the key, by which it is gathered. Null keys and texts are empty ones."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = rows.select(F.col(key), F.sha2(whole(text), 256).alias("row_sha256"), F.sha2(whole(key), 256).alias("at"))
    x = x.groupBy(key, "at", "row_sha256").agg(F.count(F.lit(1)).alias("n"))
    return x.select(key, "row_sha256", "n", "at", F.sha2(F.concat_ws(":", "at", "row_sha256", F.col("n").cast("string")), 256).alias("leaf"))


def tree(leaves_: DataFrame, depth: int) -> DataFrame:
    """(depth, prefix, n, sha256) of all nodes; depth 0 is the root. A node's hash is that of its children's hashes in order; without rows there is no node."""
    joined = lambda order, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(h).alias("h")))), lambda s: s["h"]), ""), 256)
    level = leaves_.groupBy(F.substring("at", 1, depth).alias("prefix")).agg(F.sum("n").alias("n"), joined(F.col("leaf").alias("o"), "leaf").alias("sha256"))
    out = level.select(F.lit(depth).alias("depth"), "prefix", "n", "sha256")
    for d in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, d).alias("p")).agg(F.sum("n").alias("n"), joined(F.col("prefix").alias("o"), "sha256").alias("sha256")).withColumnRenamed("p", "prefix")
        out = out.unionByName(level.select(F.lit(d).alias("depth"), "prefix", "n", "sha256"))
    return out


def differences(saved: DataFrame, found: DataFrame, saved_leaves: DataFrame, found_leaves: DataFrame, key: str, depth: int) -> DataFrame:
    """(key, problem) of rows that are changed, missing or added, found by going down from the root: only children of nodes that differ are looked at."""
    both = saved.alias("a").join(found.alias("b"), ["depth", "prefix"], "full").where(~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))).select("depth", "prefix")
    odd = both.where("depth = 0").select("prefix")
    for d in range(1, depth + 1):
        here = both.where(F.col("depth") == d).select("prefix")
        odd = here.join(odd.select(F.col("prefix").alias("up")), F.substring("prefix", 1, d - 1) == F.col("up"), "left_semi")
    own = lambda x, name: x.withColumn("prefix", F.substring("at", 1, depth)).join(odd, "prefix", "left_semi").select(F.col(key), "row_sha256", "n", F.lit(name).alias("side"))
    only = own(saved_leaves, "saved").unionByName(own(found_leaves, "found")).groupBy(key, "row_sha256", "n").agg(F.collect_set("side").alias("s")).where("size(s) = 1").select(key, F.col("s")[0].alias("side"))
    sides = only.groupBy(key).agg(F.array_sort(F.collect_set("side")).alias("s"))
    return sides.select(key, F.when(F.size("s") == 2, "changed").when(F.col("s")[0] == "saved", "missing").otherwise("added").alias("problem"))


# --- exports ----------------------------------------------------------------------------------------------------------


def request_text(request: Column) -> Column:
    """A request as compact JSON, keys in the order of its fields, nulls kept: what has to be the same byte by byte for the same hash."""
    return F.to_json(request, {"ignoreNullFields": "false"})


def _row_text(messages: Column) -> Column:
    return F.to_json(messages, {"ignoreNullFields": "true"})


def images(rows: DataFrame) -> DataFrame:
    """(location) of all images that the rows' messages name, each once."""
    blocks = F.flatten(F.transform("messages", lambda m: m["content"]))
    return rows.select(F.explode(F.transform(F.filter(blocks, lambda b: b["type"] == "image"), lambda b: b["image"])).alias("location")).distinct()


def _refuse(condition: bool, why: str) -> None:
    if condition:
        raise ValueError(why)


def export(rows: DataFrame, path: str, key: str, media: DataFrame | None = None, preview: bool = False) -> None:
    """Writes rows (key, messages, partition, loss_scope, intended_use) as JSON lines, their leaves, the tree, the media that they name, and a summary.

    Refused: no rows, several partitions, loss scopes or uses in one export, messages that do not alternate, an image that is not in media (location, sha256,
    width, height) or is there with different bytes, a path that exists. A preview may have any partition, other exports train, validation or test.
    """
    spark = rows.sparkSession
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(portable(F.col("messages")), F.lit(False))).alias("odd"), *[f(c).alias(f"{name}_{c}") for c in ("partition", "loss_scope", "intended_use") for name, f in (("lo", F.min), ("hi", F.max))]).first()
    _refuse(not told["n"], "no rows to export")
    for c in ("partition", "loss_scope", "intended_use"):
        _refuse(told[f"lo_{c}"] is None or told[f"lo_{c}"] != told[f"hi_{c}"], f"separate exports for different values of {c}")
    _refuse(not preview and told["lo_partition"] not in ("train", "validation", "test"), "an export needs an explicit partition")
    _refuse(told["odd"] > 0, f"{told['odd']} rows are not portable")
    known = spark.createDataFrame([], "location string, sha256 string, width int, height int") if media is None else media.select("location", "sha256", "width", "height").distinct()
    named = images(rows)
    used = known.join(named, "location", "left_semi")
    _refuse(not used.groupBy("location").count().where("count > 1").isEmpty(), "an image with different bytes")
    _refuse(not named.join(known, "location", "left_anti").isEmpty(), "an image without entry")
    written = rows.select(F.col(key), "messages", _row_text(F.col("messages")).alias("row_json"))
    written.select(key, "messages").write.mode("errorifexists").json(f"{path}/rows")
    leaves(written, key, "row_json").write.parquet(f"{path}/leaves")
    depth = depth_for(told["n"])
    tree(spark.read.parquet(f"{path}/leaves"), depth).write.parquet(f"{path}/tree")
    used.write.parquet(f"{path}/media")
    root = spark.read.parquet(f"{path}/tree").where("depth = 0").first()
    summary = [("format_preview_only" if preview else "reviewed_sft_export", told["lo_partition"], told["lo_loss_scope"], told["lo_intended_use"], told["n"], depth, root["sha256"])]
    spark.createDataFrame(summary, SUMMARY).coalesce(1).write.json(f"{path}/receipt")


def _read(spark: SparkSession, path: str, key: str, key_type: str) -> DataFrame:
    x = spark.read.schema(f"`{key}` {key_type}, messages {MESSAGES}").option("mode", "FAILFAST").json(f"{path}/rows")
    return x.withColumn("row_json", _row_text(F.col("messages")))


def audit(spark: SparkSession, path: str, key: str, key_type: str = "bigint") -> DataFrame:
    """(key, problem) of an export's rows that are not those of its receipt."""
    saved, told = spark.read.parquet(f"{path}/leaves"), spark.read.schema(SUMMARY).json(f"{path}/receipt").first()
    found = leaves(_read(spark, path, key, key_type), key, "row_json")
    return differences(spark.read.parquet(f"{path}/tree"), tree(found, told["depth"]), saved, found, key, told["depth"])


def load(spark: SparkSession, path: str, key: str, key_type: str = "bigint", preview: bool = False, partition: str = "train", loss_scope: str = "final_assistant_turn", intended_use: str = "causal_intraoperative_assistance", media: DataFrame | None = None) -> DataFrame:
    """(key, messages) of an export that is what its receipt says, and what was expected; ValueError else.

    Looked at: purpose, partition, loss scope and use, number of rows, the root over all rows and over the saved leaves, portability, and that the images
    named are exactly those of the receipt; with media (location, sha256, width, height), as they are now, that these are the same.
    """
    told = spark.read.schema(SUMMARY).json(f"{path}/receipt").collect()
    _refuse(len(told) != 1, "malformed receipt")
    told = told[0]
    _refuse(told["purpose"] not in ("format_preview_only", "reviewed_sft_export"), "unknown purpose")
    _refuse(told["purpose"] == "format_preview_only" and not preview, "a draft is no reviewed training data")
    for c, want in (("partition", partition), ("loss_scope", loss_scope), ("intended_use", intended_use)):
        _refuse(told[c] != want, f"{c} is {told[c]}, not {want}")
    rows = _read(spark, path, key, key_type)
    for name, own in (("rows", leaves(rows, key, "row_json")), ("leaves", spark.read.parquet(f"{path}/leaves"))):
        root = tree(own, told["depth"]).where("depth = 0").first()
        _refuse(root is None or root["n"] != told["row_count"] or root["sha256"] != told["root_sha256"], f"the {name} are not those of the receipt")
    _refuse(not rows.where(~F.coalesce(portable(F.col("messages")), F.lit(False))).isEmpty(), "rows that are not portable")
    listed, named = spark.read.parquet(f"{path}/media"), images(rows)
    _refuse(not (named.exceptAll(listed.select("location")).isEmpty() and listed.select("location").exceptAll(named).isEmpty()), "the media are not those of the messages")
    if media is not None:
        _refuse(not listed.exceptAll(media.select(*listed.columns).distinct()).isEmpty(), "media that changed")
    return rows.select(key, "messages")
