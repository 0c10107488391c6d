"""Queries over orders, parts, vectors and labels: selection, queues, recall, intervals, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions import text as X
from caseflow.operators import intervals as IV
from caseflow.operators import metrics as M
from caseflow.operators import selection as S
from caseflow.operators import timeline as TL
from caseflow.plans.registry import query, table

# --- vectors --------------------------------------------------------------------------------------------------

VEC = "v AS (SELECT label AS case_id, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("case_id"), "vec_id", "embedding")


@query(f"WITH {VEC} SELECT case_id, vec_id, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE round(least(2.0, greatest(0.0, 1 - list_cosine_similarity(e, b))), 5) END AS change FROM v")
def adjacent_cosine_change(spark: SparkSession, d: str) -> DataFrame:
    return S.adjacent_change(vectors(spark, d), "case_id", "vec_id", "embedding")


@query(
    f"WITH {VEC} SELECT case_id, vec_id, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE round(greatest("
    + ", ".join(f"least(2.0, greatest(0.0, 1 - list_cosine_similarity(e[{i * 16 + 1}:{i * 16 + 16}], b[{i * 16 + 1}:{i * 16 + 16}])))" for i in range(4))
    + "), 5) END AS change FROM v"
)
def local_max_change(spark: SparkSession, d: str) -> DataFrame:
    return S.adjacent_change(vectors(spark, d), "case_id", "vec_id", "embedding", 4)


@query(
    """WITH v AS (SELECT label AS case_id, vec_id, round(list_var_pop(embedding::DOUBLE[]), 9) AS clarity FROM embeddings)
SELECT case_id, vec_id, round((rank() OVER (PARTITION BY case_id ORDER BY clarity) - 1 + 0.5 * (count(*) OVER (PARTITION BY case_id, clarity) - 1)) / greatest(1, count(*) OVER (PARTITION BY case_id) - 1), 6) AS midrank FROM v"""
)
def midrank_clarity(spark: SparkSession, d: str) -> DataFrame:
    x = vectors(spark, d).withColumn("clarity", F.round(S.variance("embedding"), 9))
    return S.midrank(x, "case_id", "clarity").select("case_id", "vec_id", "midrank")


@query()
def greedy_frame_selection(spark: SparkSession, d: str) -> DataFrame:
    """Eight frames of each case."""
    return S.greedy_selection(vectors(spark, d), "case_id", "vec_id", "embedding", 8, 4)


@query(
    """WITH r AS (SELECT label AS case_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n, min(vec_id) OVER (PARTITION BY label) AS lo, max(vec_id) OVER (PARTITION BY label) AS hi FROM embeddings),
t AS (SELECT case_id, k, min(lo) + (min(hi) - min(lo)) * k / 2.0 AS target FROM r, range(0, 3) g(k) GROUP BY case_id, k)
SELECT t.case_id, k::BIGINT AS anchor, arg_min(vec_id, (abs(vec_id - target), vec_id)) AS vec_id FROM t JOIN r USING (case_id) GROUP BY 1, 2"""
)
def timeline_anchors(spark: SparkSession, d: str) -> DataFrame:
    """First, middle and last frame of each case's extent (anchors far enough apart to be distinct)."""
    x = vectors(spark, d)
    ends = x.groupBy("case_id").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).withColumn("anchor", F.explode(F.sequence(F.lit(0), F.lit(2))))
    x = x.join(ends, "case_id")
    far = F.abs(F.col("vec_id") - (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("anchor") / 2.0))
    return x.groupBy("case_id", F.col("anchor").cast("long").alias("anchor")).agg(F.min_by("vec_id", F.struct(far.alias("f"), F.col("vec_id").alias("v"))).alias("vec_id"))


# --- queues ---------------------------------------------------------------------------------------------------

GROUP = "CASE o_orderstatus WHEN 'F' THEN 'better' WHEN 'O' THEN 'worse' ELSE 'unknown' END"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    g = F.when(F.col("o_orderstatus") == "F", "better").when(F.col("o_orderstatus") == "O", "worse").otherwise("unknown")
    return table(spark, d, "orders").withColumn("outcome", g)


@query(
    f"""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, {GROUP} AS outcome FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, outcome ORDER BY CASE WHEN outcome = 'better' THEN o_totalprice ELSE -o_totalprice END, o_orderkey) AS turn FROM o)
SELECT o_custkey, o_orderkey, outcome, row_number() OVER (PARTITION BY o_custkey ORDER BY (outcome = 'unknown')::INT, turn, outcome) AS queue_position FROM t"""
)
def outcome_interleave_queue(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders: better ones ascending and worse ones descending in price, in turn; unknown ones last."""
    price = F.when(F.col("outcome") == "better", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    x = S.interleave(outcomes(spark, d), "outcome", "unknown", [price, F.col("o_orderkey")], ["o_custkey"])
    return x.select("o_custkey", "o_orderkey", "outcome", F.col("queue_position").cast("long").alias("queue_position"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def queue_excluded(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY regexp_extract(p_name, '^[^0-9]*'), try_cast(regexp_extract(p_name, '[0-9]+') AS BIGINT) NULLS FIRST, p_name, p_partkey) AS place FROM part")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    head, digits = F.regexp_extract("p_name", r"^[^0-9]*", 0), F.nullif(F.regexp_extract("p_name", r"[0-9]+", 0), F.lit("")).cast("long")
    w = Window.partitionBy("p_brand").orderBy(head, digits.asc_nulls_first(), "p_name", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query(f"SELECT {GROUP} AS outcome, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


RANKED = "ranked AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority").withColumn("rank", F.row_number().over(w))


@query(
    f"""WITH {RANKED}, c AS (SELECT *, CASE WHEN percent = 0 THEN 0 ELSE greatest(1, least(n - 1, (n * percent + 50) // 100)) END AS withheld FROM ranked, (VALUES (50), (70), (90), (0)) p(percent))
SELECT o_custkey, percent, max(withheld)::BIGINT AS withheld, count(*) FILTER (rank > withheld) AS kept, min(o_orderkey) FILTER (rank > withheld) AS least_kept FROM c GROUP BY 1, 2"""
)
def cohort_conditions(spark: SparkSession, d: str) -> DataFrame:
    return S.cohorts(ranked(spark, d), "o_custkey", "rank", "o_orderkey", [50, 70, 90, 0])


MOMENT = "year(o_orderdate)"


@query(
    f"""WITH {RANKED.replace("FROM orders", "FROM orders").replace("o_totalprice, row", "o_totalprice, o_orderdate, row")}
SELECT o_custkey, {MOMENT} AS moment, count(*) AS n, min(rank) AS best_rank, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS anchors, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days FROM ranked GROUP BY 1, 2"""
)
def moments(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    x = ranked(spark, d).groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("moment"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.min("rank").cast("long").alias("best_rank"), F.array_join(F.array_sort(F.collect_set(day)), ",").alias("anchors"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("span_days"))


@query(
    f"""WITH {RANKED.replace("o_totalprice, row", "o_totalprice, o_orderdate, row")}, w AS (SELECT *, greatest(1, least(n - 1, (n * 50 + 50) // 100)) AS withheld, year(o_orderdate) AS moment FROM ranked)
SELECT o_custkey, moment, CASE WHEN bool_or(rank > withheld) THEN 'represented' ELSE 'missing' END AS status FROM w GROUP BY 1, 2"""
)
def missing_vs_represented(spark: SparkSession, d: str) -> DataFrame:
    """Moments of which nothing is left once the upper half of a customer's ranking is withheld."""
    x = ranked(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")))
    withheld = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor((F.col("n") * 50 + 50) / 100)))
    x = x.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("moment")).agg(F.bool_or(F.col("rank") > withheld).alias("r"))
    return x.select("o_custkey", "moment", F.when(F.col("r"), "represented").otherwise("missing").alias("status"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY turn, o_orderpriority) AS place FROM r) SELECT o_custkey, o_orderkey, turn, place FROM p WHERE place <= 6"""
)
def round_robin_budget(spark: SparkSession, d: str) -> DataFrame:
    x = S.round_robin(ranked(spark, d), ["o_custkey"], "o_orderpriority", ["rank"], "o_orderkey", 6)
    return x.select("o_custkey", "o_orderkey", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {RANKED}, f AS (SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY rank) = string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS chronological,
string_agg(o_orderkey, ',' ORDER BY rank) = string_agg(o_orderkey, ',' ORDER BY o_orderkey DESC) AS reversed, count(DISTINCT o_totalprice) AS scores FROM ranked GROUP BY 1)
SELECT o_custkey, chronological, reversed, scores >= 2 AS varied FROM f"""
)
def ranking_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rankings that only repeat the source order, or its reverse, or give one score to all."""
    x = ranked(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))).alias("r"), F.count_distinct("o_totalprice").alias("scores"))
    keys = F.transform("r", lambda p: p["o_orderkey"])
    return x.select("o_custkey", (keys == F.array_sort(keys)).alias("chronological"), (keys == F.reverse(F.array_sort(keys))).alias("reversed"), (F.col("scores") >= 2).alias("varied"))


# --- intervals ------------------------------------------------------------------------------------------------

DAYS = "o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day, o_totalprice FROM orders)"


def days(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("day"), "o_totalprice")


@query(
    f"""WITH {DAYS}, a AS (SELECT o_custkey, o_orderkey AS moment, day AS anchor FROM o WHERE o_totalprice >= 200000),
h AS (SELECT f.o_custkey, f.o_orderkey AS frame_id, count(DISTINCT moment) AS n, min(moment) AS m, bool_or(day = anchor) AS ex FROM o f JOIN a ON a.o_custkey = f.o_custkey AND abs(f.day - a.anchor) <= 30 GROUP BY 1, 2)
SELECT f.o_custkey, f.o_orderkey AS frame_id, CASE WHEN n IS NULL THEN 'outside' WHEN n > 1 THEN 'ambiguous' WHEN ex THEN 'exact' ELSE 'single' END AS match_kind, CASE WHEN n = 1 THEN m END AS moment
FROM o f LEFT JOIN h ON h.o_custkey = f.o_custkey AND h.frame_id = f.o_orderkey"""
)
def band_join_match_kind(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders against the days of their large ones, 30 days either way."""
    o = days(spark, d)
    anchors = o.where("o_totalprice >= 200000").select("o_custkey", F.col("o_orderkey").alias("moment"), F.col("day").alias("anchor"))
    return IV.anchor_matches(o.withColumnRenamed("o_orderkey", "frame_id"), anchors, ["o_custkey"], "day", "anchor", "moment", 30)


SPANS = "s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', min(o_orderdate)::DATE) AS a, date_diff('day', DATE '1992-01-01', max(greatest(l_shipdate, o_orderdate))::DATE) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Closed interval of days of each order, from its date to its last shipment."""
    day = lambda c: F.datediff(c.cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    ship = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    o = table(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_custkey", "o_orderkey", day(F.col("o_orderdate")).alias("a"), day(F.greatest("ship", "o_orderdate")).alias("b"))


@query(f"WITH {SPANS} SELECT x.o_custkey, x.o_orderkey AS request, y.o_orderkey AS other FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND y.a <= x.b")
def interval_overlap_requests(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    x = s.select("o_custkey", F.col("o_orderkey").alias("request"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    y = s.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return IV.overlap_join(x, y, ["o_custkey"], ("a1", "b1"), ("a2", "b2"), 120).where("request < other").select("o_custkey", "request", "other")


UNION = f"""{SPANS}, u AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
t AS (SELECT o_custkey, sum(b - a)::BIGINT AS summed, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::BIGINT AS covered, count(*) AS requests, count(*) FILTER (b - a > 100) AS broad FROM u GROUP BY 1)"""


@query(f"WITH {UNION} SELECT o_custkey, summed, covered FROM t")
def interval_union_length(spark: SparkSession, d: str) -> DataFrame:
    return IV.union_length(spans(spark, d), ["o_custkey"], "a", "b")


@query(f"WITH {UNION} SELECT o_custkey, requests, broad, summed FROM t")
def request_cost(spark: SparkSession, d: str) -> DataFrame:
    """Requests, those too broad (over 100 days), and the days asked for."""
    return spans(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("b") - F.col("a") > 100).alias("broad"), F.sum(F.col("b") - F.col("a")).alias("summed"))


@query(
    "SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'F') AS found, count(o_orderkey) FILTER (o_orderstatus <> 'O') AS wanted, round(count(o_orderkey) FILTER (o_orderstatus = 'F') / nullif(count(o_orderkey) FILTER (o_orderstatus <> 'O'), 0), 6) AS recall FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"
)
def recall_rates_null_denominator(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey")
    x = x.agg(F.count_if(F.col("o_orderstatus") == "F").alias("found"), F.count_if(F.col("o_orderstatus") != "O").alias("wanted"))
    return x.withColumn("recall", IV.rate(F.col("found"), F.col("wanted")))


# --- metrics --------------------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT l_shipmode_or AS k, v, row_number() OVER (PARTITION BY l_shipmode_or ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_shipmode_or) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_or, l_extendedprice AS v FROM lineitem))
SELECT k, count(*) AS n, round(avg(v), 2) AS mean, round(max(v), 2) AS max, round(max(v) FILTER (i = round_even(0.5 * (n - 1), 0)), 2) AS p50, round(max(v) FILTER (i = round_even(0.95 * (n - 1), 0)), 2) AS p95 FROM x GROUP BY k"""
)
def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_extendedprice").alias("v"))
    return M.nearest_rank(x, ["k"], "v", {"p50": 0.5, "p95": 0.95})


@query("SELECT o_orderpriority AS answerer, o_orderstatus AS template, count(*) AS n, count(*) FILTER (o_totalprice >= 100000) AS n_correct, round(avg((o_totalprice >= 100000)::INT), 3) AS accuracy FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))")
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").select(F.col("o_orderpriority").alias("answerer"), F.col("o_orderstatus").alias("template"), (F.col("o_totalprice") >= 100000).alias("correct"))
    return M.accuracy(g, "answerer", "template")


@query("SELECT l_returnflag, count(*) AS frames, count(*) FILTER (date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 60) AS missed, max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS worst FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def timing_budget(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines of 60 days that were missed."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("frames"), F.count_if(late > 60).alias("missed"), F.max(late).cast("long").alias("worst"))


LABELLED = "x AS (SELECT lang, toxic, quality, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "lang", "text").join(table(spark, d, "labels"), "doc_id")
    return x.select("lang", "toxic", "quality", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))


@query(
    f"""WITH {LABELLED}, c AS (SELECT lang, count(*) FILTER (spaces >= 100 AND quality = 1) AS tp, count(*) FILTER (spaces >= 100 AND quality = 0) AS fp, count(*) FILTER (spaces < 100 AND quality = 1) AS fn FROM x GROUP BY 1)
SELECT lang, tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
)
def label_f1(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(labelled(spark, d), ["lang"], F.col("spaces") >= 100, F.col("quality") == 1)


@query(
    f"""WITH {LABELLED}, t AS (SELECT lang, t * 50.0 AS threshold, count(*) FILTER (spaces >= t * 50 AND quality = 1) AS tp, count(*) FILTER (spaces >= t * 50 AND quality = 0) AS fp, count(*) FILTER (spaces < t * 50 AND quality = 1) AS fn FROM x, range(1, 18) r(t) GROUP BY lang, t),
f AS (SELECT lang, threshold, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC NULLS LAST, threshold) AS b FROM f) SELECT lang, threshold::DOUBLE AS threshold, f1 FROM b WHERE b = 1"""
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return M.sweep(labelled(spark, d), ["lang"], "spaces", F.col("quality") == 1, [50.0 * i for i in range(1, 18)])


BOX = "b AS (SELECT p_partkey, p_brand, (p_size % 10) / 20.0 AS x1, (p_size % 7) / 14.0 AS y1, (p_size % 10) / 20.0 + 0.25 + (p_partkey % 5) / 20.0 AS x2, (p_size % 7) / 14.0 + 0.2 + (p_partkey % 3) / 10.0 AS y2 FROM part)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x1, y1 = (c("p_size") % 10) / 20.0, (c("p_size") % 7) / 14.0
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 0.25 + (c("p_partkey") % 5) / 20.0).alias("x2"), (y1 + 0.2 + (c("p_partkey") % 3) / 10.0).alias("y2"))
    return table(spark, d, "part").select("p_partkey", "p_brand", box.alias("box"))


@query(
    f"""WITH {BOX}, n AS (SELECT *, lag(x1) OVER w AS u1, lag(y1) OVER w AS v1, lag(x2) OVER w AS u2, lag(y2) OVER w AS v2 FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
i AS (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS o FROM n WHERE u1 IS NOT NULL)
SELECT p_partkey, round(o / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - o), 6) AS iou FROM i"""
)
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = boxes(spark, d).withColumn("before", F.lag("box").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("before is not null")
    return x.select("p_partkey", F.round(M.iou(F.col("box"), F.col("before")), 6).alias("iou"))


@query(f"WITH {BOX} SELECT p_partkey, round(sqrt(pow(greatest(x1 - 0.9, 0, 0.9 - x2) * 16 / 9.0, 2) + pow(greatest(y1 - 0.8, 0, 0.8 - y2), 2)), 6) AS distance FROM b")
def point_box_distance(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("p_partkey", F.round(M.point_to_box(F.lit(0.9), F.lit(0.8), F.col("box"), 16 / 9.0), 6).alias("distance"))


@query(
    f"""WITH {BOX}, c AS (SELECT p_partkey, greatest(0, least(1, (x1 - 0.2) / 0.6)) AS x1, greatest(0, least(1, (y1 - 0.2) / 0.6)) AS y1, greatest(0, least(1, (x2 - 0.2) / 0.6)) AS x2, greatest(0, least(1, (y2 - 0.2) / 0.6)) AS y2 FROM b)
SELECT p_partkey, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM c WHERE x2 > x1 AND y2 > y1"""
)
def crop_remap(spark: SparkSession, d: str) -> DataFrame:
    window = F.struct(F.lit(0.2).alias("x1"), F.lit(0.2).alias("y1"), F.lit(0.8).alias("x2"), F.lit(0.8).alias("y2"))
    x = boxes(spark, d).withColumn("c", M.crop(F.col("box"), window)).where("c is not null")
    return x.select("p_partkey", *[F.round(F.col(f"c.{k}"), 5).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query(
    """WITH n AS (SELECT lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS l, p_partkey FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(l, '^.* (tin|steel|copper)$') THEN regexp_extract(l, '^(.*) (tin|steel|copper)$', 1) ELSE l END AS label, CASE WHEN regexp_matches(l, '^.* (tin|steel|copper)$') THEN regexp_extract(l, '^(.*) (tin|steel|copper)$', 2) ELSE 'body' END AS part FROM n"""
)
def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.label(F.col("p_type"), ["tin", "steel", "copper"]).alias("l")).select("p_partkey", "l.label", "l.part")


@query("SELECT p_partkey, regexp_extract(p_name, '(-?\\d+(?:\\.\\d+)?)', 1)::DOUBLE AS number, CASE lower(trim(left(p_brand, 1))) WHEN 'y' THEN true WHEN 'n' THEN false END AS flag FROM part WHERE regexp_matches(p_name, '\\d') UNION ALL SELECT p_partkey, NULL, CASE lower(trim(left(p_brand, 1))) WHEN 'y' THEN true WHEN 'n' THEN false END FROM part WHERE NOT regexp_matches(p_name, '\\d')")
def lenient_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.number(F.col("p_name")).alias("number"), X.boolean(F.substring("p_brand", 1, 1)).alias("flag"))


# --- relational baseline -----------------------------------------------------------------------------------------

PRICE = "sum(l_extendedprice * (1 - l_discount))"


def revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), revenue().alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_name, round({PRICE}, 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(revenue().alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000")
def intersect_nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def except_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey").exceptAll(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query("WITH s AS (SELECT l_suppkey, l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS r FROM s) SELECT l_suppkey, l_partkey, qty, r FROM r WHERE r <= 3")
def top_parts_per_supplier(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey")).cast("long")).where("r <= 3")
