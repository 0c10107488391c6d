"""Watched cases: a customer is a case, an order a frame at its date, its lines are labels (return flag R a structure with a box, A and N tools with a tip)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import log as L
from caseflow.operators.graph import cut_lineage
from caseflow.plans.registry import place, query, table
from caseflow.streaming import session as S

DAY = 86_400_000
SETTINGS = {"near": 0.15, "aspect": 1.0, "structures": ("R",), "empty_frames": 2}
RULES = ({"id": "close", "type": "tip_near_structure", "priority": "high", "cooldown_ms": 400 * DAY, "message": "{subject} is close to {object}."},)

#: Frames, labels that count, entries and exits, nearness, the view, and all of them as a log.
LOG = """frames AS (SELECT o_custkey AS case_id, o_orderkey AS frame_index, epoch_ms(o_orderdate) AS t_ms FROM orders),
lines AS (SELECT l_orderkey AS frame_index, l_returnflag AS label, arg_min((100 - 6 * round(l_discount * 100)) / 100.0::DOUBLE, (l_linenumber, l_partkey, l_suppkey)) AS confidence, arg_min(l_quantity / 50.0, (l_linenumber, l_partkey, l_suppkey)) AS x, arg_min((l_partkey % 100) / 100.0::DOUBLE, (l_linenumber, l_partkey, l_suppkey)) AS y FROM lineitem GROUP BY 1, 2),
obs AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t_ms, frame_index) AS a FROM frames SEMI JOIN lines USING (frame_index)),
det AS (SELECT o.*, label, confidence, x, y FROM obs o JOIN lines USING (frame_index) WHERE confidence >= 0.5),
seen AS (SELECT o.case_id, o.frame_index, o.t_ms, o.a, k.label, d.label IS NOT NULL AS present FROM obs o JOIN (SELECT DISTINCT case_id, label FROM det) k USING (case_id) LEFT JOIN det d ON d.case_id = o.case_id AND d.a = o.a AND d.label = k.label),
chg AS (SELECT *, CASE WHEN present = lag(present) OVER w THEN 0 ELSE 1 END AS c, lag(t_ms) OVER w AS before_ms FROM seen WINDOW w AS (PARTITION BY case_id, label ORDER BY a)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY case_id, label ORDER BY a) AS i FROM chg),
run AS (SELECT *, row_number() OVER (PARTITION BY case_id, label, i ORDER BY a) AS r FROM isl),
trg AS (SELECT *, CASE WHEN present THEN 'in' WHEN r >= 2 THEN 'out' END AS g FROM run),
hys AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY case_id, label ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'out') AS p FROM trg),
hyst AS (SELECT case_id, a, frame_index, t_ms, CASE WHEN g = 'in' THEN t_ms ELSE before_ms END AS onset_ms, label, g FROM hys WHERE g IS NOT NULL AND g <> p),
dist AS (SELECT t.case_id, t.a, t.frame_index, t.t_ms, t.label, t.confidence * s.confidence AS conf, greatest(s.x - 0.1 - t.x, 0.0, t.x - (s.x + 0.1)) AS dx, greatest(s.y - 0.1 - t.y, 0.0, t.y - (s.y + 0.1)) AS dy FROM det t JOIN det s ON s.case_id = t.case_id AND s.a = t.a AND s.label = 'R' WHERE t.label <> 'R'),
ntr AS (SELECT case_id, a, frame_index, t_ms, label, CASE WHEN sqrt(dx * dx + dy * dy) <= 0.15 THEN 'near' WHEN sqrt(dx * dx + dy * dy) > 0.15 * 1.5 THEN 'clear' END AS g, conf FROM dist UNION ALL SELECT case_id, a, frame_index, t_ms, label, 'gone', NULL FROM hyst WHERE g = 'out' AND label <> 'R'),
npr AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY case_id, label ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'clear') AS p FROM ntr),
nears AS (SELECT * FROM npr WHERE (g = 'near' AND p <> 'near') OR (g = 'clear' AND p = 'near')),
va AS (SELECT o.*, EXISTS (SELECT 1 FROM det d WHERE d.case_id = o.case_id AND d.a = o.a) AS s FROM obs o),
vc AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY case_id ORDER BY a) THEN 0 ELSE 1 END AS c, lag(t_ms) OVER (PARTITION BY case_id ORDER BY a) AS before_ms FROM va),
vi AS (SELECT *, sum(c) OVER (PARTITION BY case_id ORDER BY a) AS i FROM vc), vr AS (SELECT *, row_number() OVER (PARTITION BY case_id, i ORDER BY a) AS r FROM vi),
vt AS (SELECT *, CASE WHEN s THEN 'view_restored' WHEN r >= 2 THEN 'view_empty' END AS g FROM vr),
vp AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'view_restored') AS p FROM vt),
ev AS (SELECT case_id, a, 1 AS stage, frame_index, t_ms, onset_ms, CASE WHEN label = 'R' THEN CASE g WHEN 'in' THEN 'anatomy_visible' ELSE 'anatomy_hidden' END ELSE CASE g WHEN 'in' THEN 'instrument_entered' ELSE 'instrument_left' END END AS type, label AS subject, NULL AS object FROM hyst
UNION ALL SELECT case_id, a, 2, frame_index, t_ms, t_ms, CASE g WHEN 'near' THEN 'tip_near_structure' ELSE 'tip_cleared_structure' END, label, 'R' FROM nears
UNION ALL SELECT case_id, a, 3, frame_index, t_ms, CASE WHEN s THEN t_ms ELSE before_ms END, g, 'view', NULL FROM vp WHERE g IS NOT NULL AND g <> p)"""
_EVENTS = f"WITH {LOG} SELECT case_id, printf('E%06d', row_number() OVER (PARTITION BY case_id ORDER BY a, stage, subject)) AS event_id, type, subject, object, frame_index, t_ms, onset_ms FROM ev"

#: What the rule's alerts offer to say, one after another.
SAID = """o AS (SELECT case_id, t_ms, 'rule:close:' || label AS k, conf, row_number() OVER (PARTITION BY case_id ORDER BY a, label) AS n FROM nears WHERE g = 'near'),
gate(case_id, n, t_ms, k, reason, minute, last) AS (SELECT DISTINCT case_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[], MAP([]::VARCHAR[], []::BIGINT[]) FROM o
UNION ALL SELECT case_id, n, t_ms, k, r, CASE WHEN r = 'spoken' THEN list_append(minute, t_ms) ELSE minute END, CASE WHEN r = 'spoken' THEN map_concat(last, MAP([k], [t_ms])) ELSE last END FROM
(SELECT o.*, g.minute, g.last, CASE WHEN o.conf < 0.5 THEN 'low_confidence' WHEN o.t_ms - g.last[o.k] < 34560000000 THEN 'cooldown' WHEN len(list_filter(g.minute, lambda t: o.t_ms - t < 60000)) >= 1 THEN 'rate_limited' ELSE 'spoken' END AS r FROM gate g JOIN o ON o.case_id = g.case_id AND o.n = g.n + 1)),
said AS (SELECT case_id, t_ms, k AS key, reason FROM gate WHERE n > 0)"""


def frames(orders: DataFrame) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("frame_index"), F.unix_millis(at).alias("t_ms"), at.alias("at"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Of each order and return flag the first line: discounts lower the confidence, quantity and part place it."""
    first = F.min_by(F.struct("l_discount", "l_quantity", "l_partkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("l")
    # by order, so that flags, frames and the join with orders meet in one shuffle
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity").repartition("l_orderkey")
    x = lines.groupBy("l_orderkey", "l_returnflag").agg(first)
    px, py = F.col("l.l_quantity") / 50.0, F.col("l.l_partkey") % 100 / 100.0
    tool = F.col("l_returnflag") != "R"
    box = F.struct((px - 0.1).alias("x1"), (py - 0.1).alias("y1"), (px + 0.1).alias("x2"), (py + 0.1).alias("y2"))
    return x.select(
        F.col("l_orderkey").alias("frame_index"), F.col("l_returnflag").alias("label"), F.when(tool, "instrument").otherwise("anatomy").alias("kind"),
        ((100 - 6 * F.round(F.col("l.l_discount") * 100)) / 100.0).alias("confidence"), F.when(tool, F.struct(px.alias("x"), py.alias("y"))).alias("tip"), F.when(~tool, box).alias("box"),
    )


def _rows(observed: DataFrame) -> DataFrame:
    return observed.withColumn("question_id", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Three questions a case: at a third and two thirds of its time, and after its end."""
    span = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.unix_millis(F.min(F.col("o_orderdate").cast("timestamp"))).alias("lo"), F.unix_millis(F.max(F.col("o_orderdate").cast("timestamp"))).alias("hi"))
    k = span.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    return k.select("case_id", F.expr("lo + (hi - lo) * k div 3 + if(k > 3, 1, 0)").alias("t_ms"), F.format_string("Q%03d", "k").alias("question_id"))


def watched(spark: SparkSession, d: str, **more) -> DataFrame:
    x = _rows(S.observed(frames(table(spark, d, "orders")), labels(spark, d), "case_id", "frame_index"))
    return S.watch(x.unionByName(_questions(spark, d), allowMissingColumns=True).drop("at"), "case_id", S.Settings(**SETTINGS, **more))


def _events(out: DataFrame) -> DataFrame:
    return out.where("record = 'event'").select("case_id", "event_id", "type", "subject", "object", "frame_index", "t_ms", "onset_ms")


@query(_EVENTS)
def session_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of watched cases: labels in and out of view, tips near a structure, an empty view."""
    return _events(watched(spark, d))


@query(_EVENTS)
def stream_session_log(spark: SparkSession, d: str) -> DataFrame:
    """The same log from a stream of orders, joined with the static lines and kept as state."""
    L.with_state_store(spark)
    at = place(spark, "session")
    stream = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/orders.parque[t]")  # a pattern fits a file and a folder of files
    rows = _rows(S.observed(frames(stream), labels(spark, d), "case_id", "frame_index"))
    S.split(S.watch_stream(rows, "case_id", S.Settings(**SETTINGS)), f"{at}/c", f"{at}/out")
    return _events(spark.read.parquet(f"{at}/out"))


@query(f"WITH RECURSIVE {LOG}, {SAID} SELECT * FROM said")
def session_utterances(spark: SparkSession, d: str) -> DataFrame:
    """What alerts of nearness offer to say, and the gate's reason: one a minute, one a tool in 400 days."""
    return watched(spark, d, rules=RULES, per_minute=1).where("record = 'utterance'").select("case_id", "t_ms", "key", "reason")


_QUESTIONS = """span AS (SELECT o_custkey AS case_id, min(epoch_ms(o_orderdate)) AS lo, max(epoch_ms(o_orderdate)) AS hi FROM orders GROUP BY 1),
ques AS (SELECT case_id, printf('Q%03d', k) AS question_id, lo + (hi - lo) * k // 3 + CASE WHEN k > 3 THEN 1 ELSE 0 END AS at_ms FROM span, (VALUES (1), (2), (4)) t(k))"""


@query(
    f"""WITH {_QUESTIONS} SELECT case_id, question_id, at_ms AS scheduled_ms, min(o.t) AS t_ms, arg_min(o.o_orderkey, (o.t, o.o_orderkey)) AS frame_index FROM ques JOIN (SELECT *, epoch_ms(o_orderdate) AS t FROM orders) o ON o.o_custkey = case_id AND o.t >= at_ms GROUP BY 1, 2, 3"""
)
def session_asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions and the frames at which they were asked."""
    return watched(spark, d).where("record = 'asked'").select("case_id", "question_id", "scheduled_ms", "t_ms", "frame_index")


def _pct(name: str, source: str) -> str:
    parts = ["len(v)::DOUBLE", *[f"round(v[1 + round_even((len(v) - 1) * {q}, 0)::INT], 2)" for q in (0.5, 0.95)], "round(v[-1], 2)", "round(list_avg(v), 2)"]
    return f"SELECT case_id, '{name}.' || unnest(['count', 'p50', 'p95', 'max', 'mean']), unnest([{', '.join(parts)}]) FROM (SELECT case_id, list_sort(list(v)) AS v FROM ({source}) WHERE v IS NOT NULL GROUP BY 1)"


_ANSWERS = "answers AS (SELECT case_id, question_id, CASE (case_id + at_ms // 1000) % 3 WHEN 0 THEN 'answered' WHEN 1 THEN 'agent_error' END AS status, (case_id + at_ms // 1000) % 3 = 0 AND case_id % 2 = 0 AS supported, CASE WHEN (case_id + at_ms // 1000) % 3 = 0 THEN (case_id % 1000) / 8.0 END AS elapsed_ms, (case_id % 7)::DOUBLE AS staleness_ms FROM ques)"
_TIMES = "times AS (SELECT o_custkey AS case_id, 'total' AS stage, floor(o_totalprice / 100) AS ms FROM orders UNION ALL SELECT o_custkey, 'gate', (o_orderkey % 100)::DOUBLE FROM orders)"
_DONE = "done AS (SELECT a.* FROM answers a JOIN ques q USING (case_id, question_id) JOIN span USING (case_id) WHERE at_ms <= hi)"


@query(
    f"""WITH RECURSIVE {LOG}, {SAID}, {_QUESTIONS}, {_ANSWERS}, {_TIMES}, {_DONE}
SELECT case_id, 'events.' || type AS part, count(*)::DOUBLE AS value FROM ev GROUP BY 1, 2 UNION ALL SELECT case_id, 'events.alert', count(*) FROM nears WHERE g = 'near' GROUP BY 1
UNION ALL SELECT case_id, 'utterances.by_reason.' || reason, count(*) FROM said GROUP BY 1, 2 UNION ALL SELECT case_id, CASE WHEN reason = 'spoken' THEN 'utterances.spoken' ELSE 'utterances.suppressed' END, count(*) FROM said GROUP BY 1, 2
UNION ALL SELECT case_id, 'questions.by_status.' || coalesce(status, 'agent_unavailable'), count(*) FROM done GROUP BY 1, 2 UNION ALL SELECT case_id, 'questions.asked', count(*) FROM done GROUP BY 1
UNION ALL SELECT case_id, 'questions.supported', count(*) FROM done WHERE supported GROUP BY 1 UNION ALL SELECT case_id, 'questions.not_asked', count(*) FROM (SELECT case_id, question_id FROM ques EXCEPT SELECT case_id, question_id FROM done) GROUP BY 1
UNION ALL SELECT case_id, 'frames', count(*) FROM times WHERE stage = 'total' GROUP BY 1 UNION ALL SELECT case_id, 'missed_deadlines', count(*) FROM times WHERE stage = 'total' AND ms > 1000 GROUP BY 1
UNION ALL {_pct("timing.total", "SELECT case_id, ms AS v FROM times WHERE stage = 'total'")} UNION ALL {_pct("timing.gate", "SELECT case_id, ms AS v FROM times WHERE stage = 'gate'")}
UNION ALL {_pct("questions.elapsed_ms", "SELECT case_id, elapsed_ms AS v FROM done")} UNION ALL {_pct("questions.staleness_ms", "SELECT case_id, staleness_ms AS v FROM done")}""".replace("SELECT case_id, CASE WHEN reason = 'spoken' THEN 'utterances.spoken' ELSE 'utterances.suppressed' END, count(*) FROM said GROUP BY 1, 2", "SELECT case_id, p, count(*) FROM (SELECT case_id, CASE WHEN reason = 'spoken' THEN 'utterances.spoken' ELSE 'utterances.suppressed' END AS p FROM said) GROUP BY 1, 2")
)
def session_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary of watched cases. Answers and stage times come from orders: their numbers, not what an agent took."""
    o = table(spark, d, "orders")
    q, m = _questions(spark, d), F.expr("(case_id + t_ms div 1000) % 3")
    answers = q.select(
        "case_id", "question_id", F.when(m == 0, "answered").when(m == 1, "agent_error").alias("status"), ((m == 0) & (F.col("case_id") % 2 == 0)).alias("supported"),
        F.when(m == 0, F.col("case_id") % 1000 / 8.0).alias("elapsed_ms"), (F.col("case_id") % 7).cast("double").alias("staleness_ms"),
    )
    stage = lambda name, ms: o.select(F.col("o_custkey").alias("case_id"), F.lit(name).alias("stage"), ms.cast("double").alias("ms"))
    timings = stage("total", F.floor(F.col("o_totalprice") / 100)).unionByName(stage("gate", F.col("o_orderkey") % 100))
    # the summary looks at the rows out in many ways: they are computed once
    return S.summary(cut_lineage(watched(spark, d, rules=RULES, per_minute=1)), "case_id", answers, timings, 1000.0)
