"""Receipts, sources, curation, turns and nested measures over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.operators import curation as C
from caseflow.operators import lineage as L
from caseflow.operators import metrics as M
from caseflow.operators import receipts as R
from caseflow.operators import turns as T
from caseflow.operators.graph import cut_lineage
from caseflow.plans.registry import meet_on_part_of_keys, place, query, table
from caseflow.sources import tables as S

#: Rows, their leaves, how often 16 has to fold them, and the nodes of all levels.
TREE = """l AS (SELECT conv_id, sha256(t) AS row_sha256, sha256(conv_id::VARCHAR) AS ka FROM (SELECT conv_id, string_agg(turn || ':' || role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1)),
n AS (SELECT greatest(0, ceil(log10(greatest(count(*), 16) / 16.0) / log10(16.0)))::BIGINT AS depth FROM l),
leaf AS (SELECT l.*, sha256(ka || ':' || row_sha256 || ':1') AS leaf, depth FROM l, n),
t(depth, prefix, n, sha256) AS (SELECT depth, left(ka, depth), count(*)::BIGINT, sha256(string_agg(leaf, '' ORDER BY leaf)) FROM leaf GROUP BY 1, 2
UNION ALL SELECT depth - 1, left(prefix, depth - 1), sum(n)::BIGINT, sha256(string_agg(sha256, '' ORDER BY prefix)) FROM t WHERE depth > 0 GROUP BY 1, 2)"""


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(":", F.col("turn").cast("string"), "role", F.coalesce("text", F.lit("")))
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("m"))
    return x.select("conv_id", F.array_join(F.transform("m", lambda m: m["line"]), "\n").alias("t"))


@query(f"WITH RECURSIVE {TREE} SELECT * FROM t")
def receipt_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of hashes over all conversations, down to its buckets."""
    x = _conversations(spark, d)
    return R.tree(R.leaves(x, "conv_id", "t"), R.depth_for(x.count()))


@query("SELECT DISTINCT conv_id, CASE WHEN conv_id % 9 = 4 THEN 'changed' WHEN conv_id % 11 = 5 THEN 'missing' ELSE 'added' END AS problem FROM (SELECT conv_id FROM conversations WHERE conv_id % 9 = 4 OR conv_id % 11 = 5 UNION ALL SELECT conv_id + 1000000 FROM conversations WHERE conv_id % 13 = 6) WHERE conv_id >= 1000000 OR conv_id % 9 = 4 OR conv_id % 11 = 5".replace("WHEN conv_id % 9 = 4 THEN", "WHEN conv_id >= 1000000 THEN 'added' WHEN conv_id % 9 = 4 AND conv_id % 11 <> 5 THEN").replace(" ELSE 'added' END", " END"))
def receipt_differences(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that were changed, taken away or added since the receipt, found from the root down."""
    before = _conversations(spark, d)
    after = before.where("conv_id % 11 != 5").withColumn("t", F.when(F.col("conv_id") % 9 == 4, F.concat("t", F.lit("."))).otherwise(F.col("t")))
    after = after.unionByName(before.where("conv_id % 13 = 6").withColumn("conv_id", F.col("conv_id") + 1_000_000))
    depth = R.depth_for(before.count())
    a, b = R.leaves(before, "conv_id", "t"), R.leaves(after, "conv_id", "t")
    return R.differences(R.tree(a, depth), R.tree(b, depth), a, b, "conv_id", depth)


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, sha256(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10) || '\"') AS row_sha256 FROM conversations")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations through CSV files whose fields hold line ends and quotes, read back in splits of 64 KB."""
    path, size = place(spark, "csv"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.lit('"'))
    x = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), whole.alias("body"))
    x.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
    try:
        rows = S.csv_with_lines(spark, f"{path}/*.csv", ["conv_id", "turn", "body"])
        # computed while the setting holds
        return cut_lineage(rows.select("conv_id", "turn", F.sha2("body", 256).alias("row_sha256")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


#: Each event is a request on the frame of its user and type; every fourth one was made on an old version, one of seven is no edit.
REQUESTS = """raw AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 7 = 3 THEN 'delete' WHEN event_id % 7 = 5 THEN 'restore' ELSE 'edit' END AS action, row_number() OVER w AS i, lag(event_id, 1) OVER w AS one, lag(event_id, 2) OVER w AS two FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)),
req AS (SELECT *, CASE WHEN event_id % 4 = 1 THEN two ELSE one END AS expected, event_id % 5 <> 2 AS given FROM raw),
fold(user_id, event_type, i, version, deleted, event_id, rule_id) AS (SELECT DISTINCT user_id, event_type, 0::BIGINT, NULL::BIGINT, false, NULL::BIGINT, NULL::VARCHAR FROM req
UNION ALL SELECT user_id, event_type, i, CASE WHEN r IS NULL THEN event_id ELSE version END, CASE WHEN r IS NULL AND action <> 'edit' THEN action = 'delete' ELSE deleted END, event_id, r FROM
(SELECT q.*, f.version, f.deleted, CASE WHEN q.given AND q.expected IS DISTINCT FROM f.version THEN 'conflict' WHEN q.action = 'edit' AND f.deleted THEN 'deleted' END AS r FROM fold f JOIN req q ON q.user_id = f.user_id AND q.event_type = f.event_type AND q.i = f.i + 1))"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    version = lambda c: F.format_string("%012d", c)
    n = F.col("event_id")
    action = F.when(n % 7 == 3, "delete").when(n % 7 == 5, "restore").otherwise("edit")
    on = F.when(n % 4 == 1, F.lag(n, 2).over(w)).otherwise(F.lag(n, 1).over(w))
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("review_identity"), F.col("event_type").alias("frame_id"), version(n).alias("at"), action.alias("action"), F.when(action == "edit", F.concat(F.lit("text "), n.cast("string"))).alias("text"),
        (n % 5 != 2).alias("given"), F.when(on.isNotNull(), version(on)).alias("expected"),
    )


@query(f"WITH RECURSIVE {REQUESTS} SELECT user_id::VARCHAR AS review_identity, event_type AS frame_id, printf('%012d', event_id) AS at, rule_id FROM fold WHERE i > 0")
def curation_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Requests on curated frames, each held against what the ones before it left."""
    x = _requests(spark, d)
    return C.decide(spark.createDataFrame([], C.REQUEST), x).select("review_identity", "frame_id", "at", "rule_id")


@query(
    f"""WITH RECURSIVE {REQUESTS}, t AS (SELECT f.*, q.action FROM fold f JOIN req q USING (user_id, event_type, event_id) WHERE rule_id IS NULL)
SELECT user_id::VARCHAR AS review_identity, event_type AS frame_id, printf('%012d', min(event_id)) AS created_at, printf('%012d', max(event_id)) AS updated_at, coalesce(arg_max(action = 'delete', event_id) FILTER (action <> 'edit'), false) AS deleted,
'text ' || max(event_id) FILTER (action = 'edit') AS text, count(*) AS changes FROM t GROUP BY 1, 2"""
)
def curation_overlay(spark: SparkSession, d: str) -> DataFrame:
    """What is shown after two batches of requests, the second one committed twice."""
    path, x = place(spark, "curation"), _requests(spark, d)
    half = x.agg(F.format_string("%012d", F.floor(F.max(F.col("at").cast("long")) / 2))).first()[0]
    for part in (x.where(F.col("at") <= half), x.where(F.col("at") > half), x.where(F.col("at") > half)):
        C.commit(path, part)
    return C.overlay(C.read(spark, path))


#: Lines of a task of turn_rules.
LINES = 100_000

#: A customer's orders are turns, the parts of their lines the frames shown; a frame's number is its part's, the cutoff rises with the date.
TURNS = """turns AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS turn, o_orderkey % 3 <> 0 AS causal FROM orders),
cut AS (SELECT *, turn * 10 + (o_orderkey % 13) AS cutoff FROM turns),
img AS (SELECT o_custkey, turn, l_partkey % 50 AS frame, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey, turn ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS position FROM cut JOIN lineitem ON l_orderkey = o_orderkey),
seen AS (SELECT o_custkey, frame, min(turn) AS first FROM img GROUP BY 1, 2),
man AS (SELECT DISTINCT o_custkey, c.turn, frame FROM cut c JOIN img i USING (o_custkey) WHERE i.turn <= c.turn AND (frame + c.turn) % 29 <> 0 UNION SELECT o_custkey, turn, 51 FROM cut WHERE o_orderkey % 17 = 0)"""


@query(
    f"""WITH {TURNS}, vis AS (SELECT c.o_custkey, c.turn, c.cutoff, c.causal, count(s.frame) AS n, max(s.frame) AS most FROM cut c LEFT JOIN seen s ON s.o_custkey = c.o_custkey AND s.first <= c.turn GROUP BY ALL), mn AS (SELECT o_custkey, turn, count(*) AS m FROM man GROUP BY 1, 2)
SELECT o_custkey::VARCHAR AS record_id, 'cutoff' AS rule_id, turn || ':' AS key FROM (SELECT *, lag(cutoff) OVER (PARTITION BY o_custkey ORDER BY turn) AS b FROM cut) WHERE cutoff < b
UNION ALL SELECT o_custkey::VARCHAR, 'order', turn || ':' || position FROM (SELECT *, lag(frame) OVER (PARTITION BY o_custkey, turn ORDER BY position) AS b FROM img) WHERE frame < b
UNION ALL SELECT o_custkey::VARCHAR, 'future', turn || ':' || most FROM vis WHERE causal AND most > cutoff
UNION ALL SELECT o_custkey::VARCHAR, 'mode', turn || ':' FROM cut WHERE causal AND o_orderkey % 19 = 0
UNION ALL SELECT m.o_custkey::VARCHAR, 'manifest', m.turn || ':' || frame FROM man m LEFT JOIN seen s USING (o_custkey, frame) WHERE s.first IS NULL OR s.first > m.turn
UNION ALL SELECT v.o_custkey::VARCHAR, 'manifest', v.turn || ':' FROM vis v LEFT JOIN mn USING (o_custkey, turn) WHERE coalesce(m, 0) < n"""
)
def turn_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of turns and of what is visible at each, over customers' orders and parts."""
    # turns and images are dealt by customer, and all that follows stays where they are
    meet_on_part_of_keys(spark)
    lines = table(spark, d, "lineitem")
    n = lines.count() // LINES + 1
    o, w = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").repartition(n, "o_custkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cut = o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("turn"), (F.col("o_orderkey") % 3 != 0).alias("causal")).withColumn("cutoff_index", F.col("turn") * 10 + F.col("o_orderkey") % 13)
    turns = cut.withColumn("mode", F.when(F.col("o_orderkey") % 19 == 0, "retrospective").otherwise("causal_prefix"))
    # a turn is an order: with its key the window needs no shuffle after the join
    own = Window.partitionBy("o_orderkey", "o_custkey", "turn").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    images = cut.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "turn", F.row_number().over(own).alias("position"), (F.col("l_partkey") % 50).alias("frame_index"))
    images = images.repartition(n, "o_custkey").withColumn("frame_id", F.col("frame_index").cast("string"))
    seen = T.first_seen(images.where("frame_index is not null"), "o_custkey").withColumnRenamed("o_custkey", "__customer")
    named = cut.join(seen, (F.col("o_custkey") == F.col("__customer")) & F.expr("first <= turn and (frame_index + turn) % 29 != 0"), "left")
    # no union, after which the rows would have to be dealt again: 51 stands beside each frame of its turn, and counts once
    named = named.select("o_custkey", "turn", F.explode(F.array("frame_id", F.when(F.col("o_orderkey") % 17 == 0, "51"))).alias("frame_id")).where("frame_id is not null")
    return T.violations(turns.select("o_custkey", "turn", "cutoff_index", "causal", "mode"), images, "o_custkey", named).drop("message")


@query(
    """SELECT n_name AS nation, unnest(['Customers / Count', 'Customers / Balance / Lowest', 'Customers / Balance / By segment / Automobile', 'Region']) AS path,
unnest([count(c_custkey)::VARCHAR, round(min(c_acctbal) * 100)::BIGINT::VARCHAR, count(*) FILTER (lower(c_mktsegment) = 'automobile')::VARCHAR, any_value(r_name)]) AS scalar FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"""
)
def nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Measures of nations as nested JSON, flattened however deep they lie; the version and lists are left out."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c_acctbal") * 100).cast("long").alias("lowest"), F.count_if(F.lower("c_mktsegment") == "automobile").alias("a"))
    x = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(c, "n_nationkey", "left")
    balance = F.struct(F.col("lowest"), F.struct(F.coalesce("a", F.lit(0)).alias("automobile")).alias("by-segment"), F.array(F.lit(1)).alias("list"))
    whole = F.struct(F.lit("v1").alias("schema_version"), F.col("r_name").alias("region"), F.struct(F.coalesce("n", F.lit(0)).alias("count"), balance.alias("balance")).alias("customers"))
    x = x.select(F.col("n_name").alias("nation"), F.parse_json(F.to_json(whole, {"ignoreNullFields": "false"})).alias("m"))
    return M.scalar_paths(x, ["nation"], "m", ("schema_version",))


#: Customers' orders as sources of frames; a run's copy lacks one in eleven or holds another number in one of thirteen cases.
LINEAGE = """sel AS (SELECT o_custkey AS path, o_orderkey AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
cop AS (SELECT path AS run, CASE WHEN path % 13 = 5 AND i = 1 THEN frame + 1 ELSE frame END AS frame, i FROM sel WHERE NOT (path % 11 = 4 AND i = 2)),
tgt AS (SELECT path AS run, CASE WHEN path % 17 = 3 THEN -frame ELSE frame END AS frame FROM sel WHERE i % 3 = 1),
eq AS (SELECT run, string_agg(i || ':' || frame, ',' ORDER BY i, frame) AS s FROM cop GROUP BY 1), es AS (SELECT path, string_agg(i || ':' || frame, ',' ORDER BY i, frame) AS s FROM sel GROUP BY 1)"""


@query(
    f"""WITH {LINEAGE} SELECT c_custkey AS run, c_custkey AS path, CASE WHEN c_custkey % 19 = 2 OR es.s IS NULL THEN 'unknown_selection' WHEN c_custkey % 23 = 6 THEN 'source' WHEN eq.s IS DISTINCT FROM es.s THEN 'frames' WHEN c_custkey % 29 = 8 THEN 'selection'
WHEN NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.run = c_custkey) THEN 'no_target' WHEN EXISTS (SELECT 1 FROM tgt WHERE tgt.run = c_custkey AND frame < 0) THEN 'target' END AS rule_id FROM customer LEFT JOIN es ON es.path = c_custkey LEFT JOIN eq ON eq.run = c_custkey"""
)
def run_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Runs (customers) held against the selections that they name: hashes, frame sets, targets."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    sel = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("frame_id"), F.row_number().over(w).alias("i"))
    k, sha = F.col("c_custkey"), lambda *c: F.sha2(F.concat_ws(":", *[x.cast("string") for x in c]), 256)
    runs = table(spark, d, "customer").select(k.alias("run"), k.alias("path"), sha(k, (k % 23 == 6).cast("int")).alias("source_sha256"), F.when(k % 2 == 0, sha(k, F.lit("v"))).alias("selection_sha256"))
    runs = runs.withColumn("selection_sha256", F.when(F.col("run") % 29 == 8, "old").otherwise(F.col("selection_sha256")))
    p = F.col("path")
    selections = sel.where("path % 19 != 2").select("path").distinct().select("path", sha(p, F.lit(0)).alias("source_sha256"), sha(p, F.lit("v")).alias("sha256"))
    copies = sel.where("not (path % 11 = 4 and i = 2)").select(p.alias("run"), F.when((p % 13 == 5) & (F.col("i") == 1), F.col("frame_id") + 1).otherwise(F.col("frame_id")).alias("frame_id"), "i")
    targets = sel.where("i % 3 = 1").select(p.alias("run"), F.when(p % 17 == 3, -F.col("frame_id")).otherwise(F.col("frame_id")).alias("frame_id"))
    return L.run_lineage(runs, selections, copies, sel, ["i", "frame_id"], targets, sel)
