"""Queries over archive records: labels, outcomes, selection helpers, the append-only log, rounds, contracts and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators import archive as A
from caseflow.operators import graph as G
from caseflow.operators import log as L
from caseflow.plans.event_queries import FRAMES, frames
from caseflow.plans.registry import place, query, table
from caseflow.streaming import replay as R

SEGMENTS = {"automobile": "vehicle", "building": "site", "household": "home"}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())


@query(
    f"""WITH m AS (SELECT c_nationkey, c_acctbal, CASE lower(trim(c_mktsegment)) {_CASE} END AS label FROM customer)
SELECT c_nationkey, count(*) FILTER (c_acctbal >= 0 AND label IS NOT NULL) AS known, count(*) FILTER (c_acctbal >= 0 AND label IS NULL) AS unknown, count(*) FILTER (c_acctbal < 0) AS invalid FROM m GROUP BY 1"""
)
def label_counters(spark: SparkSession, d: str) -> DataFrame:
    """Known, unknown and invalid label rows of a nation; a negative balance makes a row invalid."""
    x = A.mapped(table(spark, d, "customer"), "c_mktsegment", SEGMENTS)
    return A.label_counters(x, ["c_nationkey"], "label", F.col("c_acctbal") >= 0)


@query(
    f"SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate::DATE::VARCHAR AS frame_day, CASE lower(trim(c_mktsegment)) {_CASE} END AS label FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey WHERE lower(trim(c_mktsegment)) IN ({', '.join(map(repr, SEGMENTS))})"
)
def label_rows_on_frames(spark: SparkSession, d: str) -> DataFrame:
    """Label rows joined to their frames, with labels that the mapping knows."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = A.mapped(x.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", SEGMENTS)
    return x.where("label is not null").select("l_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd").alias("frame_day"), "label")


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 1")
def not_exactly_one_outcome(spark: SparkSession, d: str) -> DataFrame:
    return A.not_exactly_one(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    """WITH l AS (SELECT doc_id, bool_or(quality = 1) AS given FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN given THEN 'provided' ELSE 'unavailable' END AS status, CASE WHEN given THEN NULL WHEN given IS NULL THEN 'no_matching_source_rows' ELSE 'blank_placeholder_rows' END AS reason FROM documents LEFT JOIN l USING (doc_id)"""
)
def label_availability(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether they have a label; a quality of 0 stands for a blank placeholder."""
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("label"))
    return A.availability(table(spark, d, "documents"), labels, "doc_id", "label")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND coalesce(trim(source), '') <> ''")
def training_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Records that are reviewed, unrestricted and assigned."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.where((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.trim(F.coalesce("source", F.lit(""))) != "")).select("doc_id")


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_quantity * l_extendedprice AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linestatus = 'F') DESC, (l_quantity - 0.0) * (l_extendedprice - 0.0) DESC, l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)
SELECT l_orderkey, l_linenumber, round(area, 2) AS area FROM b WHERE p = 1"""
)
def best_region(spark: SparkSession, d: str) -> DataFrame:
    """The preferred and then largest box of each order; boxes reach from the origin to (quantity, price)."""
    x = table(spark, d, "lineitem").withColumn("x0", F.lit(0.0)).withColumn("y0", F.lit(0.0))
    x = A.best_region(x, ["l_orderkey"], F.col("l_linestatus") == "F", "x0", "y0", "l_quantity", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"])
    return x.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).alias("area"))


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return A.bounding_box(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice")


@query(f"WITH {FRAMES} SELECT case_id, frame_index, round(avg(confidence) OVER (PARTITION BY case_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_confidence FROM frames")
def window_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of the last three frames."""
    w = Window.partitionBy("case_id").orderBy("frame_index").rowsBetween(-2, 0)
    return frames(spark, d).select("case_id", F.col("frame_index").cast("long").alias("frame_index"), F.round(F.avg("confidence").over(w), 6).alias("mean_confidence"))


@query(f"WITH {FRAMES} SELECT case_id, event_id, frame_index FROM frames WHERE frame_index BETWEEN 3 AND 8")
def frame_window(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).where("frame_index between 3 and 8").select("case_id", "event_id", F.col("frame_index").cast("long").alias("frame_index"))


@query("WITH e AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings) SELECT dim::BIGINT AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM e GROUP BY 1")
def standardization(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of each dimension, as a probe's standardisation needs them."""
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return x.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("SELECT event_type, count(*) AS positives, round(least(200.0, greatest(1.0, (sum(count(*)) OVER () - count(*)) / count(*)::DOUBLE)), 6) AS weight FROM events GROUP BY 1")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Negatives over positives of each class, between 1 and 200."""
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("positives"))
    total = n.agg(F.sum("positives").alias("total"))  # one row
    weight = F.least(F.lit(200.0), F.greatest(F.lit(1.0), (F.col("total") - F.col("positives")) / F.col("positives")))
    return n.join(F.broadcast(total)).select("event_type", "positives", F.round(weight, 6).alias("weight"))


@query(
    """WITH f AS (SELECT unnest(list_filter([CASE WHEN url IS NULL OR url NOT LIKE 'https://%' THEN 'not_https' END, CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN length(html) > 1000 THEN 'long' END], lambda x: x IS NOT NULL)) AS flag FROM pages)
SELECT flag, count(*) AS n FROM f GROUP BY 1"""
)
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda cond, name: F.when(cond, name)
    flags = F.array(flag(F.col("url").isNull() | ~F.col("url").startswith("https://"), "not_https"), flag(F.col("url").contains("?"), "query"), flag(F.length("html") > 1000, "long"))
    return table(spark, d, "pages").select(F.explode(F.array_compact(flags)).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT l_shipmode_group, count(*)::DOUBLE AS n, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS most FROM (SELECT l_returnflag AS l_shipmode_group, l_quantity FROM lineitem) GROUP BY 1)
SELECT l_shipmode_group AS name, unnest(['count', 'quantity.mean', 'quantity.max']) AS path, unnest([n, mean, most]) AS value FROM m"""
)
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nested metrics as (path, value) rows."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.max("l_quantity").alias("most"))
    return m.selectExpr("name", "stack(3, 'count', n, 'quantity.mean', mean, 'quantity.max', most) as (path, value)")


@query("SELECT s_nationkey, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM (SELECT s_nationkey, s_suppkey || ':' || s_name AS line FROM supplier) GROUP BY 1")
def inventory_hashes(spark: SparkSession, d: str) -> DataFrame:
    return A.inventory_hash(table(spark, d, "supplier"), ["s_nationkey"], ["s_suppkey", "s_name"])


@query(
    """WITH k AS (SELECT n_regionkey, n_nationkey, salt, row_number() OVER (PARTITION BY n_regionkey, salt ORDER BY sha256('ranking:' || n_regionkey || ':' || salt || ':' || n_nationkey)) AS position, row_number() OVER (PARTITION BY n_regionkey, salt ORDER BY n_nationkey) AS a, count(*) OVER (PARTITION BY n_regionkey, salt) AS n FROM nation, range(20) t(salt)),
o AS (SELECT n_regionkey, salt FROM k GROUP BY 1, 2 HAVING max(n) <= 2 OR (bool_or(position <> a) AND bool_or(position <> n + 1 - a))), f AS (SELECT n_regionkey, min(salt) AS salt FROM o GROUP BY 1)
SELECT n_regionkey, n_nationkey, salt, position FROM k JOIN f USING (n_regionkey, salt)"""
)
def hash_shuffle(spark: SparkSession, d: str) -> DataFrame:
    x = A.hash_shuffle(table(spark, d, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", ["n_nationkey"], "ranking")
    return x.select("n_regionkey", "n_nationkey", F.col("salt").cast("long").alias("salt"), F.col("position").cast("long").alias("position"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) AS place FROM orders")
def stable_by_score(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer by a coarse score, the best first; equal scores keep their order."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.round("o_totalprice", -4)), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query(
    f"""WITH {FRAMES}, n AS (SELECT case_id, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT case_id, k, k * n // 4 AS a, (k + 1) * n // 4 AS b FROM n, range(4) t(k))
SELECT case_id, k, arg_min(event_id, sha256('seed:' || k || ':' || event_id)) AS event_id FROM s JOIN frames USING (case_id) WHERE frame_index - (SELECT min(frame_index) FROM frames) >= a AND frame_index - (SELECT min(frame_index) FROM frames) < b GROUP BY 1, 2"""
)
def stratified_questions(spark: SparkSession, d: str) -> DataFrame:
    """One frame of each quarter of a case."""
    f = frames(spark, d).select("case_id", "event_id", "frame_index")
    first = F.min("frame_index").over(Window.partitionBy("case_id"))
    return A.stratified(f.withColumn("i", F.col("frame_index") - first), "case_id", "i", "event_id", 4, "seed")


@query(f"WITH {FRAMES} SELECT case_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY frame_index) - 1 AS a FROM frames) WHERE a % 3 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.stride(frames(spark, d), ["case_id"], ["frame_index"], 3).select("case_id", "event_id")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return A.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM f GROUP BY 1")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's roles, each where it occurs first."""
    f = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    x = f.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "role"))).alias("r"))
    return x.select("conv_id", F.array_join(F.transform("r", lambda e: e["role"]), ",").alias("roles"))


KINDS = ["click", "purchase", "signup", "view"]
_IN = ", ".join(map(repr, KINDS))
#: Appends one after another, event by event of all cases at once: what was taken so far is a list of ids.
LOG = f"""raw AS (SELECT user_id, event_id, (event_id * 7919) % 100 + event_id AS t_ms, event_type, CASE WHEN event_id % 5 = 0 THEN event_id - 40 END AS cited, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
fold(user_id, i, last, taken, event_id, t_ms, rule_id) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM raw
UNION ALL SELECT user_id, i, CASE WHEN r IS NULL THEN t_ms ELSE last END, CASE WHEN r IS NULL THEN list_append(taken, event_id) ELSE taken END, event_id, t_ms, r FROM
(SELECT w.*, f.last, f.taken, CASE WHEN w.event_type NOT IN ({_IN}) THEN 'unknown_type' WHEN w.t_ms < f.last THEN 'time_backwards' WHEN w.cited IS NOT NULL AND NOT list_contains(f.taken, w.cited) THEN 'unknown_citation' END AS r
FROM fold f JOIN raw w ON w.user_id = f.user_id AND w.i = f.i + 1)),
chk AS (SELECT user_id, event_id, t_ms, rule_id FROM fold WHERE i > 0)"""
_TAKEN = f"WITH RECURSIVE {LOG} SELECT user_id, event_id, t_ms, printf('E%06d', row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS log_id FROM chk WHERE rule_id IS NULL"


def appends(events: DataFrame) -> DataFrame:
    """Events as appends: a jittered time, and of every fifth event a citation of the event 40 before it."""
    x = events.select("user_id", "event_id", (F.col("event_id") * 7919 % 100 + F.col("event_id")).alias("t_ms"), "event_type")
    return x.withColumn("cites", F.when(F.col("event_id") % 5 == 0, F.array(F.col("event_id") - 40)).otherwise(F.lit([]).cast("array<bigint>")))


def checked_log(spark: SparkSession, d: str) -> DataFrame:
    return L.append(appends(table(spark, d, "events")), "user_id", "event_id", "t_ms", "event_type", "cites", KINDS)


@query(f"WITH RECURSIVE {LOG} SELECT user_id, event_id, rule_id FROM chk WHERE rule_id IS NOT NULL")
def event_log_violations(spark: SparkSession, d: str) -> DataFrame:
    return checked_log(spark, d).where("rule_id is not null").select("user_id", "event_id", "rule_id")


@query(_TAKEN)
def event_log_append(spark: SparkSession, d: str) -> DataFrame:
    return checked_log(spark, d).where("rule_id is null").select("user_id", "event_id", "t_ms", "log_id")


@query(_TAKEN)
def event_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same log, kept as the events arrive: dead letters are left out."""
    at = place(spark, "log")
    L.with_state_store(spark)
    stream = L.append_stream(appends(R.event_stream(spark, d, "events.parquet")), "user_id", "event_id", "t_ms", "event_type", "cites", KINDS)
    return R.drain(stream, f"{at}/out", f"{at}/c").where("rule_id is null").select("user_id", "event_id", "t_ms", "log_id")


@query(
    f"""WITH {FRAMES}, g AS (SELECT case_id, t_ms - lag(t_ms, 1, 0) OVER (PARTITION BY case_id ORDER BY frame_index) > 3600000 AS late, label, confidence FROM frames)
SELECT case_id, count(*) AS frames, count(*) FILTER (late) AS missed_deadlines, count(DISTINCT label) AS labels, count(*) FILTER (confidence >= 0.5) AS seen FROM g GROUP BY 1"""
)
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a case's session; a frame that comes an hour after the one before misses its deadline."""
    late = F.col("t_ms") - F.lag("t_ms", 1, 0).over(Window.partitionBy("case_id").orderBy("frame_index")) > 3_600_000
    x = frames(spark, d).select("case_id", late.alias("late"), "label", "confidence")
    return x.groupBy("case_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("late").alias("missed_deadlines"), F.count_distinct("label").alias("labels"), F.count_if(F.col("confidence") >= 0.5).alias("seen"))


@query("SELECT l_returnflag, count(*) AS answers, round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 6) AS mean_staleness, max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))::BIGINT AS max_staleness FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def answer_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Days from a question (order) to its answers' delivery (shipment)."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.date_diff("l_shipdate", "o_orderdate")
    return x.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("answers"), F.round(F.avg(days), 6).alias("mean_staleness"), F.max(days).cast("long").alias("max_staleness"))


ROUNDS = "rounds AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS round, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """A customer's years are rounds, the parts bought are the items that they bring."""
    x = table(spark, d, "orders").join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("o_custkey", F.year("o_orderdate").cast("long").alias("round"), "l_partkey")


@query(
    f"""WITH {ROUNDS}, f AS (SELECT o_custkey, l_partkey, min(round) AS round FROM rounds GROUP BY 1, 2), n AS (SELECT o_custkey, round, count(*) AS new FROM f GROUP BY 1, 2), r AS (SELECT DISTINCT o_custkey, round FROM rounds)
SELECT o_custkey, round, coalesce(new, 0) AS new, sum(coalesce(new, 0)) OVER (PARTITION BY o_custkey ORDER BY round)::BIGINT AS so_far FROM r LEFT JOIN n USING (o_custkey, round)"""
)
def rounds_progress(spark: SparkSession, d: str) -> DataFrame:
    return A.progress(rounds(spark, d), "o_custkey", "round", "l_partkey")


@query(f"WITH {ROUNDS}, f AS (SELECT o_custkey, min(round) AS first FROM rounds GROUP BY 1) SELECT DISTINCT o_custkey, l_partkey FROM rounds JOIN f USING (o_custkey) WHERE round > first EXCEPT SELECT o_custkey, l_partkey FROM rounds JOIN f USING (o_custkey) WHERE round = first")
def newly_introduced(spark: SparkSession, d: str) -> DataFrame:
    """Items of later rounds that the first one had not."""
    x = rounds(spark, d).withColumn("first", F.min("round").over(Window.partitionBy("o_custkey")))
    return x.where("round > first").select("o_custkey", "l_partkey").distinct().join(x.where("round = first"), ["o_custkey", "l_partkey"], "left_anti")


@query(
    f"""WITH {ROUNDS}, i AS (SELECT DISTINCT o_custkey, round, l_partkey FROM rounds WHERE l_partkey % 3 <> 0), e AS (SELECT DISTINCT o_custkey, round, l_partkey FROM rounds WHERE l_partkey % 4 <> 0)
SELECT *, 'undecided' AS problem FROM (SELECT * FROM i EXCEPT SELECT * FROM e) UNION ALL SELECT *, 'not_introduced' FROM (SELECT * FROM e EXCEPT SELECT * FROM i)"""
)
def decision_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every introduced item (parts that 3 does not divide) needs a decision (parts that 4 does not divide) in its round, and the other way round."""
    x = rounds(spark, d)
    return A.undecided(x.where("l_partkey % 3 != 0"), x.where("l_partkey % 4 != 0"), ["o_custkey", "round", "l_partkey"])


@query(f"WITH {ROUNDS} SELECT o_custkey, l_partkey, max(round) - min(round) AS span FROM rounds GROUP BY 1, 2 HAVING max(round) - min(round) > 1")
def wide_moments(spark: SparkSession, d: str) -> DataFrame:
    return A.wide_moments(rounds(spark, d), ["o_custkey", "l_partkey"], "round", 1)


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE NOT coalesce(l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY, false)")
def outside_request(spark: SparkSession, d: str) -> DataFrame:
    """Shipments outside the sixty days after their order."""
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("end", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return A.outside_request(x, "l_shipdate", "o_orderdate", "end").select("l_orderkey", "l_linenumber")


@query(
    """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS e FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(100.0 - (o_totalprice - e), 2) AS off FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE e IS NULL OR abs(100.0 - (o_totalprice - e)) > 0.01"""
)
def risk_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose claimed difference of 100 is not their total less the sum of their lines."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("e"))
    x = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return A.arithmetic(x, "o_orderkey", F.col("o_totalprice"), F.col("e"), F.lit(100.0), 0.01).withColumn("off", F.round("off", 2))


@query("SELECT c_custkey, regexp_extract(c_name, '^Customer#(\\d{9})$', 1) AS number FROM customer WHERE c_custkey % 7 = 0 OR regexp_extract(c_name, '^Customer#(\\d{9})$', 1) <> printf('%09d', c_custkey)")
def id_rules(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in names, of every seventh customer and of those whose name does not say their key."""
    number = F.regexp_extract("c_name", r"^Customer#(\d{9})$", 1)
    return table(spark, d, "customer").where((F.col("c_custkey") % 7 == 0) | (number != F.format_string("%09d", "c_custkey"))).select("c_custkey", number.alias("number"))


@query("SELECT DISTINCT o_custkey, o_orderstatus, CASE WHEN o_custkey % 10 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'O' END END AS assigned FROM orders WHERE o_orderstatus IS DISTINCT FROM CASE WHEN o_custkey % 10 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'O' END END")
def split_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Partitions (status) that differ from the manifest's assignment of their group (customer); every tenth group has none."""
    manifest = table(spark, d, "customer").where("c_custkey % 10 != 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 3 == 0, "F").otherwise("O").alias("assigned"))
    return A.split_disagreement(table(spark, d, "orders"), "o_custkey", "o_orderstatus", manifest)


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'fraction' ELSE 'count' END AS unit, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 15 ELSE l_quantity / 2 END AS v, CASE WHEN l_tax > 0.01 THEN 1 END AS den FROM lineitem)
SELECT l_orderkey, l_linenumber, unit AS rule_id FROM m WHERE (unit = 'fraction' AND (den IS NULL OR v NOT BETWEEN 0 AND 1)) OR (unit = 'count' AND v <> floor(v))"""
)
def measurement_bounds(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    return A.measurement_bounds(x, ["l_orderkey", "l_linenumber"], F.when(even, "fraction").otherwise("count"), F.when(even, F.col("l_discount") * 15).otherwise(F.col("l_quantity") / 2), F.when(F.col("l_tax") > 0.01, 1))


@query("WITH x AS (SELECT o_custkey, unnest(['o_orderstatus', 'o_orderpriority']) AS \"column\", unnest([count(DISTINCT o_orderstatus), count(DISTINCT o_orderpriority)]) AS n FROM orders GROUP BY 1) SELECT * FROM x WHERE n > 1")
def export_homogeneity(spark: SparkSession, d: str) -> DataFrame:
    """Columns that have several values within a customer's export."""
    return A.mixed(table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("SELECT s_suppkey, s_nationkey IS NOT DISTINCT FROM c_nationkey AND s_acctbal IS NOT DISTINCT FROM c_acctbal AS same FROM supplier JOIN customer ON c_custkey = s_suppkey UNION ALL SELECT s_suppkey, true FROM supplier WHERE s_suppkey % 2 = 0")
def canonical_match(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers against the customers of their key, and the even ones against themselves: equal in all columns, nulls included."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))
    cols = ["s_nationkey", "s_acctbal"]
    return A.rows_differ(s, c, "s_suppkey", cols).union(A.rows_differ(s.where("s_suppkey % 2 = 0"), s, "s_suppkey", cols))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS found, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END) AS listed FROM documents WHERE doc_id % 5 = 0")
def asset_hash_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Assets whose bytes are not those of the manifest; every fifth one's entry is of another version."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents")
    manifest = docs.select(F.col("doc_id").alias("asset"), F.sha2(F.concat(text, F.when(F.col("doc_id") % 5 == 0, " ").otherwise("")), 256).alias("listed"))
    x = docs.select("doc_id", F.sha2(text, 256).alias("found")).join(manifest, F.col("doc_id") == F.col("asset"))
    return x.where("found != listed").select("doc_id", "found", "listed")


@query(
    f"""WITH {FRAMES}, e AS (SELECT *, t_ms - (frame_index % 3) * 450 AS onset_ms FROM frames),
p AS (SELECT event_id, printf('E%06d t=%.1fs %s %s', event_id, t_ms / 1000.0::DOUBLE, label, CASE WHEN frame_index % 2 = 0 THEN label || ' -> case' ELSE label END) AS head,
array_to_string(list_filter([CASE WHEN onset_ms <> t_ms THEN printf('onset=%.1fs', onset_ms / 1000.0::DOUBLE) END, CASE WHEN confidence < 1 THEN printf('conf=%.2f', confidence) END, CASE WHEN frame_index = 1 THEN 'frames=1' ELSE printf('frames=%d-%d', frame_index - 1, frame_index) END,
CASE WHEN frame_index % 5 = 0 THEN printf('cites=E%06d,E%06d', event_id, event_id + 1) END], lambda x: x IS NOT NULL), ', ') AS inside FROM e)
SELECT event_id, head || ' (' || inside || ')' AS line FROM p"""
)
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as their log's lines."""
    n, i = F.col("event_id"), F.col("frame_index").cast("long")
    eid = lambda c: F.format_string("E%06d", c)
    x = frames(spark, d).select(
        n, eid(n).alias("id"), "t_ms", (F.col("t_ms") - i % 3 * 450).alias("onset_ms"), F.col("label").alias("type"), F.col("label").alias("subject"), F.when(i % 2 == 0, "case").alias("object"), "confidence",
        F.when(i == 1, F.array(i)).otherwise(F.array(i - 1, i)).alias("evidence_frames"), F.when(i % 5 == 0, F.array(eid(n), eid(n + 1))).alias("cites"),
    )
    return x.withColumnsRenamed({"event_id": "n", "id": "event_id"}).select(F.col("n").alias("event_id"), L.line().alias("line"))


@query("SELECT p_partkey, upper(substring(t, 1, 1)) || substring(t, 2) AS said FROM (SELECT p_partkey, 'the ' || CASE WHEN p_size > 40 THEN 'unknown' ELSE replace(lower(p_type), '_', ' ') END || ' part is ' || coalesce(nullif(trim(p_brand), ''), 'unknown') AS t FROM part)")
def filled_templates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") <= 40, A.humanized(F.lower("p_type")))
    return table(spark, d, "part").select("p_partkey", A.filled("the {kind} part is {brand}", {"kind": kind, "brand": F.col("p_brand")}).alias("said"))


@query("SELECT page_id, substring(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80) AS slug FROM pages WHERE url IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("url is not null").select("page_id", A.slug(F.col("url")).alias("slug"))


@query(
    """WITH s AS (SELECT p_partkey, p_size AS w, (p_size * 7) % 50 + 1 AS h FROM part), c AS (SELECT *, least(w, (3 * w + 4) // 5) AS cw, least(h, (3 * h + 4) // 5) AS ch FROM s),
b AS (SELECT DISTINCT p_partkey, w, h, x AS x0, y AS y0, x + cw AS x1, y + ch AS y1 FROM (SELECT *, unnest([0, w - cw, 0, w - cw]) AS x, unnest([0, 0, h - ch, h - ch]) AS y FROM c))
SELECT p_partkey, x0, y0, x1, y1 FROM b WHERE NOT (x0 = 0 AND y0 = 0 AND x1 = w AND y1 = h)"""
)
def crop_windows(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_size") * 7 % 50 + 1).alias("h"))
    return x.select("p_partkey", F.explode(A.crops(F.col("w"), F.col("h"))).alias("b")).select("p_partkey", "b.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderstatus = 'F' THEN 'selected' WHEN o_orderstatus = 'O' THEN 'dropped' WHEN o_custkey % 2 = 0 THEN 'candidate' ELSE 'source' END AS status FROM orders")
def frame_status(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "drop").otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", A.status(F.col("o_orderkey") % 11 == 0, decision, F.col("o_custkey") % 2 == 0).alias("status"))


@query("SELECT conv_id, max(length('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}')) AS longest FROM conversations GROUP BY 1")
def answer_budget(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the longest encoded answer head of a conversation."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.length(F.to_json(F.struct("turn", "role")))).cast("long").alias("longest"))


CYCLIC = "hop AS (SELECT n_nationkey AS src, (n_nationkey * n_nationkey + 3) % 25 AS dst FROM nation)"


@query(f"WITH RECURSIVE {CYCLIC}, r AS (SELECT src, dst FROM hop UNION SELECT r.src, h.dst FROM r JOIN hop h ON h.src = r.dst) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM hop WHERE src IN (SELECT src FROM r WHERE src = dst)")
def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges on cycles of a graph in which each node has one edge."""
    n = F.col("n_nationkey").cast("long")
    return G.on_cycles(table(spark, d, "nation").select(n.alias("src"), ((n * n + 3) % 25).alias("dst")))
