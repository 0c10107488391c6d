"""Queries over reviewed material: frame pairs, scoring, probe targets, stored answers, output rules, audits, jobs and frozen tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators import review as R
from caseflow.plans.event_queries import FRAMES, frames
from caseflow.plans.registry import query, spread, table


@query(
    f"""WITH {FRAMES}, z AS (SELECT case_id, frame_index - 1 AS i FROM frames), g AS (SELECT case_id, i // 2 AS pair, min(i) AS first, max(i) AS last FROM z GROUP BY 1, 2)
SELECT case_id, pair::BIGINT AS pair, first::BIGINT AS first, last::BIGINT AS last, first = last AS padded, printf('<%.1f seconds>', (first + last) / 2.0) AS label FROM g"""
)
def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Frames two by two, at one frame a second."""
    x = frames(spark, d).select("case_id", (F.col("frame_index") - 1).cast("long").alias("i"))
    return R.pairs(x, "case_id", "i", 1.0)


@query(
    f"""WITH {FRAMES}, x AS (SELECT case_id, frame_index, t_ms, CASE WHEN value >= 50 THEN 40 WHEN value >= 20 THEN 0 END AS own, lag(t_ms) OVER (PARTITION BY case_id ORDER BY frame_index) AS b, first_value(t_ms) OVER (PARTITION BY case_id ORDER BY frame_index) AS f FROM frames),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY frame_index DESC) = 1)
SELECT case_id, (t_ms - f + CASE WHEN own > 0 THEN own ELSE coalesce(t_ms - b, 0) END)::BIGINT AS extent, CASE WHEN own > 0 THEN 'own_duration' WHEN b IS NOT NULL THEN 'previous_interval' ELSE 'unknown' END AS basis FROM l"""
)
def case_extent(spark: SparkSession, d: str) -> DataFrame:
    """A case's length; of frames with a value of 50 and more the duration is known, of those from 20 it is 0."""
    x = frames(spark, d).withColumn("own", F.when(F.col("value") >= 50, 40).when(F.col("value") >= 20, 0))
    return R.extent(x, "case_id", "frame_index", "t_ms", "own").withColumn("extent", F.col("extent").cast("long"))


@query(
    """WITH c AS (SELECT source, lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
f AS (SELECT source, CASE WHEN 2 * tp + fp + fn > 0 THEN round(20000 * tp / (2 * tp + fp + fn)::DOUBLE)::BIGINT END AS f FROM c) SELECT source, count(f) AS classes, (2 * sum(f)::BIGINT + count(f)) // (2 * count(f)) / 10000.0::DOUBLE AS f1_macro FROM f GROUP BY 1"""
)
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Quality as a prediction of harmlessness, by language, averaged over a source's languages."""
    x = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    return R.macro_f1(x, ["source"], "lang", F.col("quality") == 1, F.col("toxic") == 0)


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount * 5 AS x, l_tax * 5 AS y, l_quantity % 7 <> 0 AS boxed FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS x, l_discount * 5 AS y, l_linenumber % 3 <> 0 AS pointed FROM lineitem WHERE l_quantity > 5),
m AS (SELECT l_returnflag, CASE WHEN pointed THEN sqrt(power((t.x - g.x) * 1.5, 2) + power(t.y - g.y, 2)) END AS e, CASE WHEN boxed THEN greatest(0.0, least(t.x, g.x) + 0.3 - greatest(t.x, g.x)) * greatest(0.0, least(t.y, g.y) + 0.3 - greatest(t.y, g.y)) END AS i FROM t JOIN g USING (l_orderkey, l_linenumber))
SELECT l_returnflag, count(*) AS matched, round(avg(e), 4) AS tip_error, round(avg(i / (0.18 - i)), 4) AS mean_iou FROM m GROUP BY 1"""
)
def detection_errors(spark: SparkSession, d: str) -> DataFrame:
    """Detections (tip at (x, y), box of 0.3 by 0.3 from there) against the truth of their frame (order) and label (line)."""
    box = lambda x, y: F.struct(x.alias("x1"), y.alias("y1"), (x + 0.3).alias("x2"), (y + 0.3).alias("y2"))
    tip = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows, on = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    x, y, gx = F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity") / 100
    truth = rows.select(*on, "l_returnflag", tip(x, y).alias("tip"), F.when(F.col("l_quantity") % 7 != 0, box(x, y)).alias("box"))
    found = rows.where("l_quantity > 5").select(*on, F.when(F.col("l_linenumber") % 3 != 0, tip(gx, x)).alias("tip"), box(gx, x).alias("box"))
    return R.matched_errors(truth, found, on, ["l_returnflag"], 1.5)


@query(
    """WITH s AS (SELECT p_partkey, p_size * 40 + 100 AS w, (p_size * 7) % 50 * 30 + 90 AS h FROM part)
SELECT p_partkey, CASE WHEN w >= h THEN greatest(1, round_even(16 * w / h, 0))::INTEGER ELSE 16 END AS cols, CASE WHEN w >= h THEN 16 ELSE greatest(1, round_even(16 * h / w, 0))::INTEGER END AS rows FROM s"""
)
def probe_grid(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 100).alias("w"), (F.col("p_size") * 7 % 50 * 30 + 90).alias("h"))
    return x.select("p_partkey", R.grid(F.col("w"), F.col("h")).alias("g")).select("p_partkey", "g.*")


@query(
    """WITH b AS (SELECT p_partkey, p_size / 64.0 AS x1, (p_size * 7 % 50) / 64.0 AS y1, p_size / 64.0 + (p_partkey % 4) / 16.0 + 0.015625 AS x2, (p_size * 7 % 50) / 64.0 + (p_partkey % 3) / 16.0 + 0.015625 AS y2 FROM part),
c AS (SELECT p_partkey, col FROM b, range(16) t(col) WHERE (col + 0.5) / 16 BETWEEN x1 AND x2), r AS (SELECT p_partkey, r."row" FROM b, range(8) r("row") WHERE (r."row" + 0.5) / 8 BETWEEN y1 AND y2), g AS (SELECT p_partkey, r."row", col FROM c JOIN r USING (p_partkey))
SELECT p_partkey, "row"::INTEGER AS "row", col::INTEGER AS col FROM g UNION ALL SELECT p_partkey, least(floor((y1 + y2) / 2 * 8), 7)::INTEGER, least(floor((x1 + x2) / 2 * 16), 15)::INTEGER FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM g)"""
)
def probe_targets(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a grid of 16 by 8 that a box fills; all numbers are binary fractions."""
    x1, y1 = F.col("p_size") / 64, F.col("p_size") * 7 % 50 / 64
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + F.col("p_partkey") % 4 / 16 + 1 / 64).alias("x2"), (y1 + F.col("p_partkey") % 3 / 16 + 1 / 64).alias("y2"))
    return R.box_cells(table(spark, d, "part"), ["p_partkey"], box, 16, 8)


_CITED = "list_filter(string_split(text, ' '), lambda x: x <> '')"


@query(
    f"""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_CITED} AS cited FROM conversations)
SELECT conv_id, turn, 'c' || i AS claim_id, list_unique(cited)::BIGINT AS n_cited, CASE WHEN list_unique(cited) < len(cited) THEN 'duplicate_citations_removed ' ELSE '' END || CASE WHEN n = 4 THEN 'claim_cap_reached' ELSE '' END AS flags FROM c"""
)
def stored_claims(spark: SparkSession, d: str) -> DataFrame:
    """Messages as claims that cite their words; four fill an answer."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.filter(F.split("text", " "), lambda w: w != "").alias("cited"))
    x = R.stored_claims(x, "conv_id", "turn", "cited", 4)
    flag = lambda name, end: F.when(F.array_contains("flags", name), name + end).otherwise("")
    return x.select("conv_id", "turn", "claim_id", F.size("cited").cast("long").alias("n_cited"), F.concat(flag("duplicate_citations_removed", " "), flag("claim_cap_reached", "")).alias("flags"))


@query(
    """SELECT conv_id, md5(string_agg(replace(role || '_visible', '_', ' ') || ' · turn ' || turn || ': ' || text || chr(10) || 'Evidence: V' || turn || ', V' || (turn + 1) || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Uncertainty: unclear' ELSE '' END, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1"""
)
def annotation_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of a conversation's claims as a reviewer sees it."""
    t = F.col("turn").cast("string")
    cited = F.array(F.concat(F.lit("V"), t), F.concat(F.lit("V"), (F.col("turn") + 1).cast("string")))
    line = R.claim_text(F.concat("role", F.lit("_visible")), F.concat(F.lit("turn_"), t), F.col("text"), cited, F.when(F.col("turn") % 2 == 0, "unclear").otherwise(""))
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return x.select("conv_id", F.md5(F.array_join(F.transform("l", lambda e: e["line"]), "\n\n").cast("binary")).alias("text_md5"))


@query(
    f"WITH {FRAMES} SELECT event_id, event_id || '; released frame index ' || frame_index || '; ' || CASE WHEN confidence < 0.5 THEN 'acquisition timestamp unavailable' ELSE 'timestamp ' || t_ms || ' ms (' || label || ')' END || '.' AS caption FROM frames"
)
def frame_captions(spark: SparkSession, d: str) -> DataFrame:
    basis = F.when(F.col("confidence") < 0.5, "unavailable").otherwise(F.col("label"))
    return frames(spark, d).select("event_id", R.frame_caption(F.col("event_id"), F.col("frame_index"), F.col("t_ms"), basis).alias("caption"))


@query(
    """WITH i AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '-x' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'e' || o_orderkey % 5 END AS id, o_orderstatus = 'O' AS u, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'why' END AS w FROM orders),
r AS (SELECT o_custkey, o_orderkey, CASE WHEN id IS NULL OR NOT regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9_.:-]*$') THEN 'invalid_id' WHEN row_number() OVER (PARTITION BY o_custkey, id ORDER BY o_orderkey) > 1 THEN 'duplicate_id' WHEN u AND trim(w) = '' THEN 'unexplained' END AS rule_id FROM i)
SELECT * FROM r WHERE rule_id IS NOT NULL"""
)
def rejected_items(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the items of one output."""
    k = F.col("o_orderkey")
    item = F.when(k % 9 == 0, "-x").when(k % 9 != 1, F.concat(F.lit("e"), (k % 5).cast("string")))
    x = table(spark, d, "orders").withColumn("id", item).withColumn("why", F.when(k % 2 == 0, " ").otherwise("why"))
    return R.rejected_items(x, "o_custkey", "o_orderkey", "id", F.col("o_orderstatus") == "O", "why")


@query(
    """WITH c AS (SELECT o_custkey, 'e' || o_orderkey % 40 AS claim_id FROM orders UNION ALL SELECT o_custkey, 'e' || o_orderkey % 40 || '.uncertainty' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 'e' || o_orderkey % 30 || '.uncertainty.answer' FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, claim_id, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) > 1"""
)
def claim_collisions(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    events = o.select("o_custkey", F.concat(F.lit("e"), (k % 40).cast("string")).alias("event"), F.when(F.col("o_orderstatus") == "O", "unclear").otherwise(" ").alias("uncertainty"))
    questions = o.where("o_orderstatus = 'F'").select("o_custkey", F.concat(F.lit("e"), (k % 30).cast("string"), F.lit(".uncertainty")).alias("question"))
    return R.claim_collisions(events, questions, "o_custkey", "event", "uncertainty", "question")


@query(
    """WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS place, l_returnflag AS q, l_linenumber AS a, CASE WHEN l_quantity > 2 THEN floor(l_quantity / 6)::BIGINT END AS b FROM lineitem),
r AS (SELECT l_suppkey, place, CASE WHEN NOT coalesce(1 <= a AND a <= b AND b <= 7, false) THEN 'outside' WHEN row_number() OVER (PARTITION BY l_suppkey, lower(trim(q)), a, b ORDER BY place) > 1 THEN 'duplicate' END AS rule_id FROM s)
SELECT * FROM r WHERE rule_id IS NOT NULL"""
)
def rejected_searches(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's lines as searches from the line number to a sixth of the quantity, in a window from 1 to 7."""
    x = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), "l_returnflag", "l_linenumber", F.when(F.col("l_quantity") > 2, F.floor(F.col("l_quantity") / 6)).alias("end"))
    return R.rejected_searches(x, "l_suppkey", "place", "l_returnflag", "l_linenumber", "end", 1, 7)


@query(
    """WITH r AS (SELECT l_orderkey, count(*) FILTER (a IS NOT NULL) AS n, bool_or(l_linestatus = 'F') AS ready, count(*) FILTER (a IS NOT NULL AND NOT coalesce(a < b, false)) AS e, count(*) FILTER (a IS NOT NULL AND b - a > 20) AS l FROM (SELECT l_orderkey, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 4 END AS a, l_quantity AS b FROM lineitem) GROUP BY 1)
SELECT l_orderkey, 'too_many' AS rule_id FROM r WHERE n > 2 UNION ALL SELECT l_orderkey, 'ready_and_asking' FROM r WHERE ready AND n > 0 UNION ALL SELECT l_orderkey, 'empty_interval' FROM r WHERE e > 0 UNION ALL SELECT l_orderkey, 'too_long' FROM r WHERE l > 0"""
)
def request_audit(spark: SparkSession, d: str) -> DataFrame:
    """An order is a round, its even lines are requests; 20 at most, and half of a length of 50."""
    x = table(spark, d, "lineitem").withColumn("a", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 4))
    return R.request_audit(x, ["l_orderkey"], "a", "l_quantity", F.col("l_linestatus") == "F", 2, F.least(F.lit(20.0), F.lit(50) / 2))


_ATTEMPTS = "a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'accepted' WHEN o_orderkey % 6 < 4 THEN 'failed' END AS status FROM orders), j AS (SELECT c_custkey, CASE WHEN bool_or(status = 'accepted') THEN 'done' WHEN count(o_orderkey) = 0 THEN 'pending' ELSE arg_max(coalesce(status, 'interrupted'), o_orderkey) END AS state, count(o_orderkey) AS attempts FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY 1)"


def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Customers are jobs, their orders attempts."""
    k = F.col("o_orderkey") % 6
    attempts = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(k == 0, "accepted").when(k < 4, "failed").alias("status"))
    return R.job_state(table(spark, d, "customer"), attempts, "c_custkey", "o_orderkey", "status")


@query(f"WITH {_ATTEMPTS} SELECT c_custkey, state, attempts FROM j WHERE state <> 'done'")
def batch_todo(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed batch runs: jobs without an accepted attempt."""
    return job_states(spark, d).where("state != 'done'")


@query(f"WITH {_ATTEMPTS} SELECT state, count(*) AS jobs, sum(attempts)::BIGINT AS attempts FROM j GROUP BY 1")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    return job_states(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("jobs"), F.sum("attempts").alias("attempts"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders), s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN place + 1 ELSE place END AS place FROM r WHERE o_orderkey % 70 <> 0)
SELECT *, 'saved' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'rebuilt' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM s)"""
)
def frozen_differences(spark: SparkSession, d: str) -> DataFrame:
    """A saved queue with shifted and lost places against the one that its inputs give."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = spread(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))
    s = r.where("o_orderkey % 70 != 0").withColumn("place", F.when(F.col("o_orderkey") % 50 == 0, F.col("place") + 1).otherwise(F.col("place")))
    return R.frozen_differences(s, r, ["o_custkey", "o_orderkey", "place"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality END AS quality, CASE WHEN doc_id % 3 = 0 THEN toxic END AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def curation_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a document's own revision; two thirds of them belong to an older one."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("rev"))
    notes = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 3).alias("rev"), "quality", "toxic")
    return R.overlay(docs, notes, "doc_id", "rev", ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("SELECT c_custkey, unnest(['keep', 'rank']) AS item, unnest([CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END, c_mktsegment]) AS decision FROM customer")
def decision_rows(spark: SparkSession, d: str) -> DataFrame:
    """A map of decisions as rows."""
    m = F.create_map(F.lit("keep"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no"), F.lit("rank"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.explode(m).alias("item", "decision"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey // 2)::BIGINT AS dst FROM nation WHERE n_nationkey > 0), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst), q AS (SELECT n_nationkey::BIGINT AS node, n_nationkey % 5 AS cutoff FROM nation WHERE n_nationkey % 2 = 1),
a AS (SELECT n_nationkey::BIGINT AS node, CASE WHEN n_regionkey = 4 THEN 'evaluation_report' ELSE 'image' END AS role, n_nationkey % 7 AS frame FROM nation), i AS (SELECT src AS node, dst FROM c UNION SELECT node, node FROM q)
SELECT q.node, i.dst, CASE WHEN role = 'evaluation_report' THEN 'role' ELSE 'future_frame' END AS rule_id FROM q JOIN i ON i.node = q.node JOIN a ON a.node = i.dst WHERE role = 'evaluation_report' OR frame > cutoff"""
)
def causal_violations(spark: SparkSession, d: str) -> DataFrame:
    """Assets (nations) derived from the one of half their number; the odd ones are asked for."""
    n = F.col("n_nationkey").cast("long")
    x = table(spark, d, "nation")
    edges = x.where("n_nationkey > 0").select(n.alias("src"), F.floor(n / 2).alias("dst"))
    asked = x.where("n_nationkey % 2 = 1").select(n.alias("node"), (n % 5).alias("cutoff"))
    assets = x.select(n.alias("node"), F.when(F.col("n_regionkey") == 4, "evaluation_report").otherwise("image").alias("role"), (n % 7).alias("frame"))
    return R.causal_violations(asked, edges, assets, ["evaluation_report"])
