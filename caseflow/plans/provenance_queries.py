"""Provenance, releases, annotations and sources over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators import annotations as A
from caseflow.operators import provenance as P
from caseflow.operators import timeline as TL
from caseflow.plans.event_queries import FRAMES, frames
from caseflow.plans.registry import query, table
from caseflow.sources import tables as S

_RELEASED = "idx AS (SELECT o_custkey AS key, arg_min(o_orderstatus, lpad(o_orderkey::VARCHAR, 12, '0')) AS partition FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1)"


def _receipts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("receipt_path"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("partition"), "o_orderkey")


@query(f"WITH {_RELEASED} SELECT * FROM idx")
def release_index(spark: SparkSession, d: str) -> DataFrame:
    """The partition in which a customer was first released; three of four orders are receipts."""
    return P.release_index(_receipts(spark, d).where("o_orderkey % 4 != 0"))


@query(f"WITH {_RELEASED} SELECT o_orderkey, o_custkey AS key, o_orderstatus AS partition, idx.partition AS released FROM orders JOIN idx ON key = o_custkey WHERE o_orderkey % 4 = 0 AND o_orderstatus <> idx.partition")
def release_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """New orders of customers that an earlier release put into another partition."""
    x = _receipts(spark, d)
    return P.release_conflicts(x.where("o_orderkey % 4 = 0").drop("receipt_path"), P.release_index(x.where("o_orderkey % 4 != 0")))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS digests FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def asset_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders for which more than one flag is stated."""
    return P.asset_conflicts(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", F.array_join("digests", ",").alias("digests"))


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 5 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 11 <> 4)
SELECT coalesce(a.k, b.k) AS path, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h"""
)
def inventory_diff(spark: SparkSession, d: str) -> DataFrame:
    """Missing, extra and changed entries of one listing of orders against another."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("digest"))
    found = x.where("path % 11 != 4").withColumn("digest", F.when(F.col("path") % 13 == 5, "X").otherwise(F.col("digest")))
    return P.inventory_diff(x.where("path % 10 != 3"), found, "path", "digest")


@query(
    """WITH a AS (SELECT conv_id, turn, md5(coalesce(text, '')) AS h FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn % 3 = 1 THEN 'x' ELSE h END AS h FROM a WHERE NOT (conv_id % 4 = 0 AND turn >= 2))
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.turn, b.turn)) AS turn FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.h IS DISTINCT FROM b.h GROUP BY 1"""
)
def first_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """The first turn at which a conversation and a copy of it, cut short or changed, differ."""
    a = table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    b = a.where("not (conv_id % 4 = 0 and turn >= 2)").withColumn("h", F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") % 3 == 1), "x").otherwise(F.col("h")))
    return P.first_mismatch(a, b, ["conv_id"], "turn", "h")


#: An order is a run; every third one continues the order before it of its customer. Its lines are what it saw.
EXPOSED = """runs AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS parent_id FROM orders),
up(run_id, seen) AS (SELECT run_id, run_id FROM runs UNION SELECT up.run_id, r.parent_id FROM up JOIN runs r ON r.run_id = up.seen WHERE r.parent_id IS NOT NULL),
ex AS (SELECT up.run_id, max(l_partkey) AS max_frame, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS saw_outcome FROM up JOIN lineitem ON l_orderkey = seen GROUP BY 1)"""


def _exposure(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 3 != 0, F.lag("o_orderkey").over(w)).alias("parent_id"))
    runs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("frame_index"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("outcome"))
    return P.exposure(runs.join(parents.select("run_id"), "run_id", "left_semi"), parents)


@query(f"WITH RECURSIVE {EXPOSED} SELECT * FROM ex")
def run_exposure(spark: SparkSession, d: str) -> DataFrame:
    """The latest frame that a run or any of its ancestors saw, and whether one saw an outcome."""
    return _exposure(spark, d)


@query(
    f"""WITH RECURSIVE {EXPOSED}, c AS (SELECT o_orderkey::VARCHAR AS claim_id, o_orderkey AS run_id, o_custkey AS cutoff_index, o_orderkey % 2 = 0 AS causal FROM orders)
SELECT claim_id AS record_id, 'future_frame' AS rule_id, max_frame::VARCHAR AS key FROM c JOIN ex USING (run_id) WHERE max_frame > cutoff_index UNION ALL SELECT claim_id, 'outcome', run_id::VARCHAR FROM c JOIN ex USING (run_id) WHERE causal AND saw_outcome"""
)
def exposure_violations(spark: SparkSession, d: str) -> DataFrame:
    """Claims of orders whose runs saw later frames than they may, or outcomes."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("claim_id"), F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("cutoff_index"), (F.col("o_orderkey") % 2 == 0).alias("causal"))
    return P.exposure_violations(claims, _exposure(spark, d)).drop("message")


@query(
    """SELECT o_custkey AS review_identity, o_orderkey AS frame_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 1 AND o_orderkey % 7 <> 2 AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 3 = 0)"""
)
def approved_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes that may be exported: reviewed, not to be checked again, on the curation as it is now, not deleted."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("review_identity"), k.alias("frame_id"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft").alias("status"), (k % 4 == 1).alias("needs_recheck"), F.when(k % 5 == 0, k).alias("curation_updated_at"))
    curation = x.where("frame_id % 5 = 0 or frame_id % 7 = 2").select("review_identity", "frame_id", F.when(F.col("frame_id") % 7 == 2, -1).otherwise(F.col("frame_id")).cast("long").alias("updated_at"), (F.col("frame_id") % 3 == 0).alias("deleted"))
    return A.approved(x, curation).select("review_identity", "frame_id")


@query("SELECT conv_id, coalesce(string_agg(md5(coalesce(text, '')), ' ' ORDER BY turn) FILTER (role = 'user'), '') AS visible_caption, coalesce(string_agg(md5(coalesce(text, '')), ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS inferred_caption FROM conversations GROUP BY 1")
def captions_by_support(spark: SparkSession, d: str) -> DataFrame:
    """What users said as visible, what assistants said as inferred captions, by hash of the texts."""
    support = F.when(F.col("role") == "user", "visible").when(F.col("role") == "assistant", "inferred")
    return A.captions(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("claim_id"), support.alias("support"), F.md5(F.coalesce("text", F.lit(""))).alias("statement")), "conv_id")


@query(
    f"""WITH {FRAMES}, x AS (SELECT case_id, frame_index, abs((t_ms - min(t_ms) OVER (PARTITION BY case_id)) * 1 * 30000 - (frame_index - 1) * 1001 * 1000) AS off FROM frames)
SELECT case_id, max(off)::BIGINT AS max_off, bool_and(off * 4 <= least(1 * 30000 * 4, 1001 * 1000)) AS within FROM x GROUP BY 1"""
)
def nominal_deviation(spark: SparkSession, d: str) -> DataFrame:
    """How far the times of a case's frames lie from 30000 / 1001 frames a second, in exact units."""
    x = frames(spark, d).select("case_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("t_ms").alias("pts"), F.lit(1).cast("long").alias("tb_num"), F.lit(1000).cast("long").alias("tb_den"))
    return TL.nominal_deviation(x, "case_id", 30000, 1001)


@query(
    """WITH v AS (SELECT l_orderkey AS packet, l_partkey AS frame, l_suppkey AS o, l_linenumber, l_quantity, l_extendedprice, (SELECT max(l_partkey) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R') AS target, l_returnflag = 'R' AS full_ FROM lineitem a),
s AS (SELECT *, CASE WHEN frame = target THEN 'T' WHEN frame < target THEN 'B' ELSE 'A' END AS side FROM v WHERE target IS NOT NULL), f AS (SELECT *, side = 'T' AND full_ AS whole FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY packet, side, whole ORDER BY frame, o, l_linenumber, l_quantity, l_extendedprice) AS p FROM f)
SELECT packet, CASE WHEN whole THEN 'T' ELSE side || p END AS view_label, count(*) AS n FROM n GROUP BY 1, 2"""
)
def view_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of an order's parts as views: the largest returned one is the target, other parts come before or after it."""
    x = table(spark, d, "lineitem")
    target = x.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_partkey").alias("target"))
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    x = x.join(target, "l_orderkey").withColumn("o", order).withColumn("role", F.when(F.col("l_returnflag") == "R", "full").otherwise("crop"))
    return A.view_labels(x, "l_orderkey", "target", "l_partkey", "o", "role").groupBy(F.col("l_orderkey").alias("packet"), "view_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FRAMES}, f AS (SELECT case_id, frame_index FROM frames WHERE event_id % 40 <> 7), g AS (SELECT case_id, min(frame_index) AS lo, max(frame_index) AS hi, count(*) AS n FROM f GROUP BY 1)
SELECT 'S' || case_id AS case_id, CASE WHEN lo <> 1 THEN 'does not start at 1' ELSE 'gap' END AS problem FROM g WHERE lo <> 1 OR hi <> n"""
)
def release_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Cases of which a released directory lacks frames, told from the names of its files."""
    name = F.format_string("frames/S%d/S%d_frame_%08d.jpeg", "case_id", "case_id", "frame_index")
    return S.release_violations(S.frame_files(frames(spark, d).where("event_id % 40 != 7").select(name.alias("path"))))


_BOX = "CASE WHEN l_orderkey % 9 = 0 THEN 'n/a' ELSE (l_quantity * 10)::BIGINT::VARCHAR END"


@query(
    f"""WITH p AS (SELECT l_orderkey::VARCHAR AS trial_frame, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE l_returnflag END AS label, {_BOX} AS a, (l_partkey % 700)::VARCHAR AS b, CASE WHEN l_linestatus = 'F' THEN 'tool_tips' ELSE 'bbox' END AS source_table, l_suppkey % 600 AS c FROM lineitem),
v AS (SELECT *, trim(label) <> '' AND a <> 'n/a' AS valid, least(1.0, try_cast(a AS DOUBLE) / 640) AS xa, CASE WHEN source_table = 'tool_tips' THEN least(1.0, try_cast(a AS DOUBLE) / 640) ELSE least(1.0, c / 640.0::DOUBLE) END AS xb, least(1.0, try_cast(b AS DOUBLE) / 480) AS ya, CASE WHEN source_table = 'tool_tips' THEN least(1.0, try_cast(b AS DOUBLE) / 480) ELSE least(1.0, c / 480.0::DOUBLE) END AS yb FROM p),
g AS (SELECT DISTINCT trial_frame, source_table, CASE WHEN valid THEN label END AS label, CASE WHEN valid THEN least(xa, xb) END AS x1, CASE WHEN valid THEN least(ya, yb) END AS y1, CASE WHEN valid THEN greatest(xa, xb) END AS x2, CASE WHEN valid THEN greatest(ya, yb) END AS y2 FROM v)
SELECT trial_frame, source_table, label, round(x1, 9) AS x1, round(y1, 9) AS y1, round(x2, 9) AS x2, round(y2, 9) AS y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 'point' WHEN x1 IS NOT NULL THEN 'box' END AS kind FROM g"""
)
def label_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Points and boxes of two label tables as one, normalised to a picture of 640 x 480; some have no number, some no label."""
    text = lambda c: c.cast("string")
    a = F.when(F.col("l_orderkey") % 9 == 0, "n/a").otherwise(text((F.col("l_quantity") * 10).cast("long")))
    label = F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.col("l_returnflag"))
    x = table(spark, d, "lineitem").select(text(F.col("l_orderkey")).alias("trial_frame"), label.alias("label"), a.alias("x1"), text(F.col("l_partkey") % 700).alias("y1"), text(F.col("l_suppkey") % 600).alias("c"), "l_linestatus")
    points = x.where("l_linestatus = 'F'").select("trial_frame", "label", "x1", "y1", F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    boxes = x.where("l_linestatus != 'F'").select("trial_frame", "label", "x1", "y1", F.col("c").alias("x2"), F.col("c").alias("y2"))
    out = S.label_rows(points, boxes, 640, 480)
    return out.select("trial_frame", "source_table", "label", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")], "kind")
