"""Queries over conversations, documents and pages: contracts, hygiene, hashes, graphs, exports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.functions import text as X
from caseflow.operators import contracts as K
from caseflow.operators import exports as E
from caseflow.operators import graph as G
from caseflow.plans.event_queries import observations, frames
from caseflow.plans.registry import place, query, table
from caseflow.streaming import replay as R


@query(
    """WITH m AS (SELECT conv_id::VARCHAR AS r, turn, role, text, row_number() OVER w - 1 AS p, lag(role) OVER w AS b, lead(role) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT r AS record_id, 'turn_gap' AS rule_id, turn::VARCHAR AS key, 'turns are not 0, 1, 2, ...' AS message FROM m WHERE turn <> p
UNION ALL SELECT r, 'role', turn::VARCHAR, 'unknown role' FROM m WHERE role NOT IN ('system', 'user', 'assistant')
UNION ALL SELECT r, 'system_late', turn::VARCHAR, 'system message after the first' FROM m WHERE role = 'system' AND p > 0
UNION ALL SELECT r, 'same_role', turn::VARCHAR, 'two messages of one role in a row' FROM m WHERE role = b
UNION ALL SELECT r, 'start', turn::VARCHAR, 'the first message is not a user''s' FROM m WHERE b IS NULL AND role NOT IN ('user', 'system')
UNION ALL SELECT r, 'end', turn::VARCHAR, 'the last message is not an assistant''s' FROM m WHERE a IS NULL AND role <> 'assistant'
UNION ALL SELECT r, 'empty', turn::VARCHAR, 'empty text' FROM m WHERE coalesce(trim(text), '') = ''"""
)
def message_contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return K.message_rules(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1), s AS (SELECT conv_id, len(roles) AS n, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS rest FROM m)
SELECT conv_id, n, len(rest) > 0 AND len(rest) % 2 = 0 AND len(list_filter(rest, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS portable FROM s"""
)
def portable_messages(spark: SparkSession, d: str) -> DataFrame:
    x = E.message_rows(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return x.select("conv_id", F.size("messages").cast("long").alias("n"), E.portable(F.col("messages")).alias("portable"))


@query("WITH m AS (SELECT conv_id, turn, role, length(text) AS n, lead(role) OVER w AS nr, lead(length(text)) OVER w AS nn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, n AS asked, nn AS answered FROM m WHERE role = 'user' AND nr = 'assistant'")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("asked"))
    x = x.withColumn("next", F.lead("role").over(w)).withColumn("answered", F.lead("asked").over(w))
    return x.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", "asked", "answered")


@query("SELECT l_orderkey || '/' || l_partkey AS record_id, 'unique' AS rule_id, count(*)::VARCHAR AS key, 'key is not unique' AS message FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return K.unique(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"], "unique")


@query("SELECT o_orderkey::VARCHAR AS record_id, 'customer' AS rule_id, o_custkey::VARCHAR AS key, 'unknown reference' AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer is unknown among those with a positive balance."""
    return K.references(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "o_orderkey", "customer")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def bidirectional_review_links(spark: SparkSession, d: str) -> DataFrame:
    return K.sets_differ(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, 3 AS start, 9 AS \"end\", substring(text, 1, 6) AS quote FROM documents WHERE substring(text, 4, 6) <> substring(text, 1, 6)")
def span_equality(spark: SparkSession, d: str) -> DataFrame:
    """Claims that the first six characters stand at [3, 9): those that are wrong."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    claims = docs.select("doc_id", F.lit(3).alias("start"), F.lit(9).alias("end"), F.substring("text", 1, 6).alias("quote"))
    return K.span_mismatches(claims, docs, "doc_id")


@query("SELECT doc_id, length(regexp_replace(substring(text, 101, 100) || substring(text, 251), '\\s', '', 'g')) AS uncovered FROM documents")
def full_text_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters outside [0, 60), [40, 100) and [200, 250)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 60), (40, 100), (200, 250))])).alias("s")).select("doc_id", "s.*")
    return K.uncovered(spans, docs, "doc_id").withColumn("uncovered", F.col("uncovered").cast("long"))


@query(
    """WITH x AS (SELECT n_regionkey AS p, c_mktsegment, c_nationkey, round(c_acctbal)::BIGINT AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT p, unnest([{'key_kind': 'c_mktsegment', 'key': c_mktsegment}, {'key_kind': 'c_nationkey', 'key': c_nationkey::VARCHAR}, {'key_kind': 'balance', 'key': balance::VARCHAR}], recursive := true) FROM x)
SELECT key_kind, key, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS partitions FROM k WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT p) > 1"""
)
def partition_leakage(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    x = x.select(F.col("n_regionkey").cast("string").alias("p"), "c_mktsegment", "c_nationkey", F.round("c_acctbal").cast("long").alias("balance"))
    return K.leakage(x, ["c_mktsegment", "c_nationkey", "balance"], "p")


@query("SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE lang = 'en' INTERSECT SELECT md5(text) FROM documents WHERE lang <> 'en'")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Texts that two splits share (none if they are disjoint)."""
    h = table(spark, d, "documents").select("lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return h.where("lang = 'en'").select("text_md5").intersect(h.where("lang != 'en'").select("text_md5"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}') AS row_sha256 FROM documents")
def canonical_row_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(K.canonical(["source", "lang", "doc_id"]), 256).alias("row_sha256"))


@query("WITH s AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS s FROM conversations) SELECT a.conv_id, a.turn, b.turn AS other FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.s = b.s AND a.s <> ''")
def restated_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation that say the same once case and punctuation are set aside."""
    s = table(spark, d, "conversations").select("conv_id", "turn", X.statement(F.col("text")).alias("s")).where("s != ''")
    o = s.select("conv_id", F.col("turn").alias("other"), "s")
    return s.join(o, ["conv_id", "s"]).where("turn < other").select("conv_id", "turn", "other")


@query()
def restatement_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation with all earlier ones at a similarity ratio of 0.93 or more; lengths are compared first."""
    return K.restatements(table(spark, d, "conversations").select("conv_id", "turn", X.statement(F.col("text")).alias("s")), "conv_id", "turn", "s", 0.93)


@query(
    "WITH f AS (SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in sorted(X.HYGIENE.items()))
    + "], lambda x: x IS NOT NULL) AS c FROM documents) SELECT doc_id, array_to_string(c, ',') AS categories FROM f WHERE len(c) > 0"
)
def hygiene_findings(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", X.findings(F.col("text")).alias("c")).where(F.size("c") > 0)
    return x.select("doc_id", F.array_join("c", ",").alias("categories"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\b(of the|the|of|and the|and)\\b', 1))), ',') AS mentions FROM documents WHERE lang = 'en'")
def mention_extract(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with the longest label first: "and the" is not "and"."""
    x = table(spark, d, "documents").where("lang = 'en'")
    return x.select("doc_id", F.array_join(X.mentions(F.col("text"), ["the", "of", "and", "of the", "and the"]), ",").alias("mentions"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html")).cast("binary")).alias("escaped_md5"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS p FROM pages) SELECT page_id, length(p) > 0 AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AND NOT contains(p, '\\') AND NOT contains(p, ':') AS safe FROM p")
def safe_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.safe_path(F.regexp_replace("url", r"^https?://[^/]*/?", "")).alias("safe"))


# --- graphs: nations of a region, regions of a root; turns of a conversation -----------------------------------------

EDGES = "edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"))
    r = table(spark, d, "region").select(node("r", "r_regionkey").alias("src"), F.lit("root").alias("dst"))
    return n.union(r).union(table(spark, d, "supplier").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst")))


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst) SELECT src, dst FROM edges WHERE src IN (SELECT src FROM r WHERE src = dst)")
def acyclic_check(spark: SparkSession, d: str) -> DataFrame:
    return G.on_cycles(edges(spark, d))


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges e ON e.src = c.dst) SELECT * FROM c")
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(edges(spark, d))


@query(f"WITH RECURSIVE {EDGES}, t AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT e.src, t.depth + 1 FROM t JOIN edges e ON e.dst = t.node) SELECT node, min(depth) AS depth FROM t GROUP BY 1")
def taint_propagation(spark: SparkSession, d: str) -> DataFrame:
    """All that descends from region 0, with its distance."""
    down = edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable(spark.createDataFrame([("r0",)], "node string"), down)


@query(
    """WITH r AS (SELECT conv_id, string_agg(role || ':' || sha256(text), ';' ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, sha256(t) AS row_sha256 FROM r"""
)
def export_rows_with_receipt(spark: SparkSession, d: str) -> DataFrame:
    rows = E.message_rows(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.sha2(m["content"][0]["text"], 256))), ";")
    return rows.select("conv_id", E.row_hash(text).alias("row_sha256"))


@query()
def degraded_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations with seeded misses (20 %) and jittered confidence: a hash of seed and event decides."""
    u = lambda salt: F.pmod(F.xxhash64(F.lit(17), "event_id", F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    x = frames(spark, d).where(u("miss") >= 0.2)
    return x.select("case_id", "event_id", "frame_index", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + (u("jitter") - 0.5) * 0.1)), 6).alias("confidence"))


# --- streams: the events table replayed as files to its end ------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark, "tumbling")
    return R.drain_table(R.tumbling(R.event_stream(spark, d, "events.parquet"), "1 hour", "1 day"), f"{at}/c", ["start", "event_type"], f"{at}/out")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return R.sessions(x, "6 hours", "1 day")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark, "dedup")
    return R.drain(R.deduplicated(R.event_stream(spark, d, "events.parquet"), ["event_type", "user_id"], "3650 days").select("event_type", "user_id"), f"{at}/out", f"{at}/c")


@query()
def stream_detector(spark: SparkSession, d: str) -> DataFrame:
    """The keyed detector over events replayed as a stream: equal to hysteresis_entries and hysteresis_exits."""
    at = place(spark, "detector")
    observations(frames(spark, d)).select("case_id", "t_ms", "labels", F.col("frame_index").cast("long").alias("order")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("case_id long, t_ms long, labels array<string>, `order` long").parquet(f"{at}/in")
    return R.drain(R.detector(stream, 1, 2), f"{at}/out", f"{at}/c")
