"""Queries over the event stream: a user is a case, an event type a label, value / 100 (1 at most) its confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import detectors as D
from caseflow.operators import events as E
from caseflow.operators import timeline as TL
from caseflow.plans.registry import query, table

FLOOR = 0.5

FRAMES = """frames AS (SELECT user_id AS case_id, event_id, event_type AS label, value, least(value / 100.0, 1.0) AS confidence,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_index,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS t_ms FROM events)"""
#: Half of each case's time.
NOWS = "nows AS (SELECT case_id, max(t_ms) // 2 AS now_ms FROM frames GROUP BY case_id)"

SEEN = """known AS (SELECT DISTINCT case_id, label FROM frames WHERE confidence >= 0.5),
seen AS (SELECT f.case_id, f.frame_index, f.t_ms, k.label, (f.label = k.label AND f.confidence >= 0.5) AS present FROM frames f JOIN known k ON f.case_id = k.case_id),
chg AS (SELECT *, CASE WHEN present = lag(present) OVER w THEN 0 ELSE 1 END AS c FROM seen WINDOW w AS (PARTITION BY case_id, label ORDER BY frame_index)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY case_id, label ORDER BY frame_index) AS i FROM chg),
runs AS (SELECT *, row_number() OVER (PARTITION BY case_id, label, i ORDER BY frame_index) AS r,
  lag(t_ms) OVER (PARTITION BY case_id, label ORDER BY frame_index) AS before_ms FROM isl),
trg AS (SELECT *, CASE WHEN present THEN 'entered' WHEN r >= 2 THEN 'left' END AS type, CASE WHEN present THEN t_ms ELSE before_ms END AS onset_ms FROM runs),
prv AS (SELECT *, coalesce(last_value(type IGNORE NULLS) OVER (PARTITION BY case_id, label ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'left') AS p FROM trg),
hyst AS (SELECT case_id, label, type, frame_index, t_ms, onset_ms FROM prv WHERE type IS NOT NULL AND type <> p)"""

WITH = f"WITH {FRAMES}, {NOWS}, {SEEN} "


def frames(spark: SparkSession, d: str) -> DataFrame:
    x = TL.ordinals(table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_id", "ts", F.col("event_type").alias("label"), "value"), "case_id", "ts", "event_id")
    return x.withColumn("confidence", F.least(F.col("value") / 100.0, F.lit(1.0))).drop("ts")


def nows(f: DataFrame, share: int = 2) -> DataFrame:
    return f.groupBy("case_id").agg(TL.div(F.max("t_ms"), share).alias("now_ms"))


def observations(f: DataFrame) -> DataFrame:
    return f.withColumn("labels", F.when(F.col("confidence") >= FLOOR, F.array("label")).otherwise(F.lit([]).cast("array<string>")))


def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Entries at once, exits after two rows without the label."""
    return D.hysteresis(D.presence(observations(frames(spark, d)), "case_id", "frame_index", "t_ms", "labels"), "case_id", "frame_index", "t_ms", 1, 2)


@query(f"WITH {FRAMES} SELECT case_id, event_id, frame_index, t_ms FROM frames")
def frame_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("case_id", "event_id", F.col("frame_index").cast("long").alias("frame_index"), "t_ms")


@query(f"WITH {FRAMES}, x AS (SELECT case_id, frame_index, t_ms, lag(t_ms) OVER (PARTITION BY case_id ORDER BY frame_index) AS previous_ms FROM frames) SELECT * FROM x WHERE t_ms <= previous_ms")
def monotonic_violations(spark: SparkSession, d: str) -> DataFrame:
    return TL.monotonic_violations(frames(spark, d), "case_id").withColumn("frame_index", F.col("frame_index").cast("long"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS position FROM lineitem) SELECT * FROM x WHERE position <> l_linenumber")
def contiguity_gaps(spark: SparkSession, d: str) -> DataFrame:
    return TL.contiguity_gaps(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber").withColumn("position", F.col("position").cast("long"))


@query(f"WITH {FRAMES}, x AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY case_id ORDER BY frame_index) AS dur FROM frames) SELECT case_id, max(frame_index) AS frames, arg_max(dur, frame_index) AS last_duration_ms FROM x WHERE dur IS NOT NULL OR frame_index = 1 GROUP BY case_id")
def last_interval_duration(spark: SparkSession, d: str) -> DataFrame:
    return TL.last_duration(frames(spark, d), "case_id").withColumn("frames", F.col("frames").cast("long"))


@query(
    f"""WITH {FRAMES}, x AS (SELECT case_id, (frame_index - 1) // 2 AS pair, min(frame_index) AS first_index, max(frame_index) AS last_index, (min(t_ms) + max(t_ms) + 100) // 200 AS tenths FROM frames GROUP BY 1, 2)
SELECT case_id, pair, first_index, last_index, (tenths // 10)::VARCHAR || '.' || (tenths % 10)::VARCHAR || ' seconds' AS label FROM x"""
)
def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    return TL.pairs(frames(spark, d), "case_id").withColumn("first_index", F.col("first_index").cast("long")).withColumn("last_index", F.col("last_index").cast("long"))


@query(
    f"""WITH {FRAMES}, x AS (SELECT *, min(t_ms) OVER (PARTITION BY case_id) AS lo, max(t_ms) OVER (PARTITION BY case_id) AS hi, count(*) OVER (PARTITION BY case_id) AS n FROM frames)
SELECT case_id, least(3, CASE WHEN hi > lo THEN (t_ms - lo) * 4 // (hi - lo) ELSE (frame_index - 1) * 4 // n END) AS bin, count(*) AS n FROM x GROUP BY 1, 2"""
)
def equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    return TL.equal_width_bins(frames(spark, d), "case_id", 4).groupBy("case_id", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FRAMES}, m AS (SELECT case_id, max(t_ms) AS m FROM frames GROUP BY 1),
x AS (SELECT f.*, count(*) OVER (PARTITION BY f.case_id) AS n, row_number() OVER (PARTITION BY f.case_id ORDER BY t_ms, frame_index) - 1 AS i FROM frames f JOIN m USING (case_id) WHERE t_ms BETWEEN m // 4 AND 3 * m // 4)
SELECT case_id, frame_index, t_ms FROM x WHERE n <= 5 OR i IN (0, round_even((n - 1) / 4.0, 0), round_even(2 * (n - 1) / 4.0, 0), round_even(3 * (n - 1) / 4.0, 0), n - 1)"""
)
def interval_retrieval_k(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    x = f.join(f.groupBy("case_id").agg(F.max("t_ms").alias("m")), "case_id")
    return TL.evenly_spaced(x, "case_id", TL.div(F.col("m"), 4), TL.div(F.col("m") * 3, 4), 5).select("case_id", F.col("frame_index").cast("long").alias("frame_index"), "t_ms")


@query(
    f"""WITH {FRAMES}, x AS (SELECT case_id, frame_index, [lag(event_id, 2) OVER w, lag(event_id, 1) OVER w, lead(event_id, 1) OVER w, lead(event_id, 2) OVER w] AS a FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index))
SELECT case_id, frame_index, array_to_string(list_filter(a, lambda v: v IS NOT NULL), ',') AS neighbours FROM x"""
)
def context_neighbors(spark: SparkSession, d: str) -> DataFrame:
    x = TL.neighbours(frames(spark, d), "case_id", "event_id", 2)
    return x.select("case_id", F.col("frame_index").cast("long").alias("frame_index"), F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"WITH {FRAMES} SELECT case_id, frame_index, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean_value FROM frames WINDOW w AS (PARTITION BY case_id ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def context_window_9(spark: SparkSession, d: str) -> DataFrame:
    return TL.context_window(frames(spark, d), "case_id", "value", 4).withColumn("frame_index", F.col("frame_index").cast("long"))


def _log(f: DataFrame) -> DataFrame:
    return f.withColumn("type", F.col("label")).withColumn("subject", F.col("label")).withColumn("object", F.lit(None).cast("string"))


@query(
    f"""WITH {FRAMES}, {NOWS}, x AS (SELECT f.*, row_number() OVER (PARTITION BY f.case_id ORDER BY t_ms DESC, event_id DESC) AS p FROM frames f JOIN nows USING (case_id)
WHERE t_ms <= now_ms AND t_ms >= now_ms // 4 AND label IN ('click', 'purchase')) SELECT case_id, event_id, t_ms, label FROM x WHERE p <= 20"""
)
def causal_event_query(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    log = _log(f.join(nows(f), "case_id"))
    return E.causal_query(log, "case_id", F.col("now_ms"), ["click", "purchase"], since=TL.div(F.col("now_ms"), 4), limit=20).select("case_id", "event_id", "t_ms", "label")


@query(f"WITH {FRAMES}, x AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t_ms DESC, event_id DESC) AS p FROM frames) SELECT case_id, event_id, t_ms FROM x WHERE p <= 12")
def recent_n_events(spark: SparkSession, d: str) -> DataFrame:
    return E.recent(frames(spark, d), "case_id", 12).select("case_id", "event_id", "t_ms")


def _hyst(spark: SparkSession, d: str, type_: str) -> DataFrame:
    return hysteresis(spark, d).where(F.col("type") == type_).select("case_id", "label", F.col("frame_index").cast("long").alias("frame_index"), "t_ms", "onset_ms")


@query(WITH + "SELECT case_id, label, frame_index, t_ms, onset_ms FROM hyst WHERE type = 'entered'")
def hysteresis_entries(spark: SparkSession, d: str) -> DataFrame:
    return _hyst(spark, d, "entered")


@query(WITH + "SELECT case_id, label, frame_index, t_ms, onset_ms FROM hyst WHERE type = 'left'")
def hysteresis_exits(spark: SparkSession, d: str) -> DataFrame:
    return _hyst(spark, d, "left")


def _past(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return hysteresis(spark, d).join(nows(f), "case_id").where("t_ms <= now_ms")


@query(
    WITH
    + """, st AS (SELECT case_id, label, arg_max(type, frame_index) AS type FROM hyst JOIN nows USING (case_id) WHERE t_ms <= now_ms GROUP BY 1, 2)
SELECT n.case_id, n.now_ms, coalesce(string_agg(CASE WHEN type = 'entered' THEN label END, ',' ORDER BY label), '') AS visible FROM nows n LEFT JOIN st USING (case_id) GROUP BY 1, 2"""
)
def visible_now(spark: SparkSession, d: str) -> DataFrame:
    """What was in view at half of each case's time."""
    f = frames(spark, d)
    n = nows(f)
    state = E.state_at(hysteresis(spark, d).join(n, "case_id"), ["case_id", "label"], F.col("now_ms"), "frame_index", "entered")
    seen = state.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("visible"))
    return n.join(seen, "case_id", "left").select("case_id", "now_ms", F.coalesce("visible", F.lit("")).alias("visible"))


@query(
    WITH
    + """, p AS (SELECT h.*, now_ms, lead(t_ms) OVER (PARTITION BY case_id, label ORDER BY frame_index) AS next_ms FROM hyst h JOIN nows USING (case_id) WHERE t_ms <= now_ms)
SELECT case_id, label, sum(coalesce(next_ms, now_ms) - t_ms)::BIGINT AS in_view_ms FROM p WHERE type = 'entered' GROUP BY 1, 2"""
)
def time_in_view(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.expr("lead(t_ms) over (partition by case_id, label order by frame_index)")
    x = _past(spark, d).withColumn("next_ms", nxt).where("type = 'entered'")
    return x.groupBy("case_id", "label").agg(F.sum(F.coalesce("next_ms", "now_ms") - F.col("t_ms")).alias("in_view_ms"))


@query(WITH + "SELECT case_id, label, count(*) AS entries FROM hyst JOIN nows USING (case_id) WHERE t_ms <= now_ms AND type = 'entered' GROUP BY 1, 2")
def entry_count(spark: SparkSession, d: str) -> DataFrame:
    return _past(spark, d).where("type = 'entered'").groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("entries"))


@query(WITH + "SELECT case_id, label, min(t_ms) AS first_ms FROM hyst JOIN nows USING (case_id) WHERE t_ms <= now_ms AND type = 'entered' GROUP BY 1, 2")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return _past(spark, d).where("type = 'entered'").groupBy("case_id", "label").agg(F.min("t_ms").alias("first_ms"))


@query(WITH + "SELECT case_id, label, max(t_ms) AS left_ms FROM hyst JOIN nows USING (case_id) WHERE t_ms <= now_ms AND type = 'left' GROUP BY 1, 2")
def last_left(spark: SparkSession, d: str) -> DataFrame:
    return _past(spark, d).where("type = 'left'").groupBy("case_id", "label").agg(F.max("t_ms").alias("left_ms"))


@query(
    f"""WITH {FRAMES}, s AS (SELECT *, confidence >= 0.5 AS a FROM frames),
c AS (SELECT *, CASE WHEN a = lag(a) OVER (PARTITION BY case_id ORDER BY frame_index) THEN 0 ELSE 1 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY case_id ORDER BY frame_index) AS i FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, i ORDER BY frame_index) AS r, lag(t_ms, 2) OVER (PARTITION BY case_id ORDER BY frame_index) AS b FROM i),
t AS (SELECT *, CASE WHEN a THEN 'view_restored' WHEN r >= 3 THEN 'view_empty' END AS type FROM r),
p AS (SELECT *, coalesce(last_value(type IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'view_restored') AS p FROM t)
SELECT case_id, type, frame_index, t_ms, CASE WHEN a THEN t_ms ELSE b END AS onset_ms FROM p WHERE type IS NOT NULL AND type <> p"""
)
def view_empty_runs(spark: SparkSession, d: str) -> DataFrame:
    x = D.view_runs(frames(spark, d), "case_id", "frame_index", "t_ms", F.col("confidence") >= FLOOR, 3)
    return x.withColumn("frame_index", F.col("frame_index").cast("long"))


@query(
    WITH
    + """, q AS (SELECT case_id, share, max(t_ms) * share // 4 AS now_ms FROM frames, (VALUES (1), (2), (3)) s(share) GROUP BY case_id, share),
st AS (SELECT q.case_id, q.share, label, arg_max(type, frame_index) AS type FROM q JOIN hyst h ON h.case_id = q.case_id AND h.t_ms <= q.now_ms GROUP BY 1, 2, 3)
SELECT case_id, share, string_agg(label, ',' ORDER BY label) AS visible FROM st WHERE type = 'entered' GROUP BY 1, 2"""
)
def state_asof(spark: SparkSession, d: str) -> DataFrame:
    """State at a quarter, half and three quarters of each case's time."""
    f = frames(spark, d)
    q = f.groupBy("case_id").agg(F.max("t_ms").alias("m")).withColumn("share", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    q = q.select("case_id", "share", TL.div(F.col("m") * F.col("share"), 4).alias("now_ms"))
    x = E.state_at(hysteresis(spark, d).join(q, "case_id"), ["case_id", "share", "label"], F.col("now_ms"), "frame_index", "entered")
    return x.groupBy("case_id", "share").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("visible"))


@query(
    f"""WITH {FRAMES}, l AS (SELECT * FROM frames WHERE label = 'purchase'), r AS (SELECT case_id, t_ms, max(event_id) AS event_id FROM frames WHERE label = 'view' GROUP BY 1, 2)
SELECT l.case_id, l.event_id, l.t_ms, r.t_ms AS matched_t_ms, r.event_id AS matched_event_id FROM l ASOF LEFT JOIN r ON l.case_id = r.case_id AND l.t_ms >= r.t_ms"""
)
def asof_backward_join(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    left = f.where("label = 'purchase'").select("case_id", "event_id", "t_ms")
    return E.asof_backward(left, f.where("label = 'view'"), "case_id", "t_ms", ["event_id"])


@query(
    f"""WITH {FRAMES}, q AS (SELECT case_id, 'Q' || lpad(k::VARCHAR, 3, '0') AS question_id, max(t_ms) * k // 10 + 1 AS at_ms FROM frames, range(1, 11) r(k) GROUP BY case_id, k)
SELECT q.case_id, question_id, at_ms, min(f.frame_index) AS due_index, min(f.t_ms) AS due_ms FROM q LEFT JOIN frames f ON f.case_id = q.case_id AND f.t_ms >= at_ms GROUP BY 1, 2, 3"""
)
def question_due_join(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    q = f.groupBy("case_id").agg(F.max("t_ms").alias("m")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10))))
    q = q.select("case_id", F.format_string("Q%03d", F.col("k")).alias("question_id"), (TL.div(F.col("m") * F.col("k"), 10) + 1).alias("at_ms"))
    return E.first_due(q, f, "case_id").withColumn("due_index", F.col("due_index").cast("long"))


#: rule_id, type, subject, object, labels that must be in view, labels that must not, priority.
RULES = [
    ("R1", "entered", "purchase", None, ["view"], [], "critical"),
    ("R2", "entered", None, None, ["error"], ["purchase"], "warning"),
    ("R3", "left", "click", None, [], ["view"], "notice"),
    ("R4", "entered", "signup", None, [], [], "notice"),
]

RULES_SQL = """rules(rule_id, type, subject, present, absent, priority) AS (VALUES ('R1', 'entered', 'purchase', ['view'], []::VARCHAR[], 'critical'), ('R2', 'entered', NULL, ['error'], ['purchase'], 'warning'),
('R3', 'left', 'click', []::VARCHAR[], ['view'], 'notice'), ('R4', 'entered', 'signup', []::VARCHAR[], []::VARCHAR[], 'notice')),
vis AS (SELECT e.case_id, e.frame_index, e.label, e.type, e.t_ms, list(DISTINCT s.label) FILTER (s.type = 'entered') AS visible FROM hyst e LEFT JOIN LATERAL (SELECT h.label, arg_max(h.type, h.frame_index) AS type FROM hyst h WHERE h.case_id = e.case_id AND h.frame_index <= e.frame_index GROUP BY h.label) s ON true GROUP BY ALL),
hits AS (SELECT v.case_id, v.frame_index, v.label, v.type, v.t_ms, r.rule_id, r.priority FROM vis v JOIN rules r ON r.type = v.type AND (r.subject IS NULL OR r.subject = v.label) AND list_has_all(coalesce(v.visible, []), r.present) AND NOT list_has_any(coalesce(v.visible, []), r.absent))"""


def _rule_hits(spark: SparkSession, d: str) -> DataFrame:
    h = hysteresis(spark, d)
    state = E.visible_after(h, "case_id", "frame_index", "label", "type", "entered")
    events = h.join(state, ["case_id", "frame_index"]).withColumn("subject", F.col("label")).withColumn("object", F.lit(None).cast("string"))
    rules = spark.createDataFrame(RULES, "rule_id string, type string, subject string, object string, present array<string>, absent array<string>, priority string")
    return E.match_rules(events, rules).select("case_id", "frame_index", "label", "type", "t_ms", "rule_id", "priority")


@query(WITH + f", {RULES_SQL} SELECT * FROM hits")
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return _rule_hits(spark, d).withColumn("frame_index", F.col("frame_index").cast("long"))


@query(WITH + f", {RULES_SQL} SELECT rule_id, priority, count(*) AS alerts, count(DISTINCT case_id) AS cases FROM hits GROUP BY 1, 2")
def rule_alert_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rule_hits(spark, d).groupBy("rule_id", "priority").agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("case_id").alias("cases"))


#: Steps by label; transitions that are allowed; the order that is expected.
STEP_OF = {"view": "browse", "click": "inspect", "purchase": "buy"}
ALLOWED = {"idle": ["browse"], "browse": ["inspect"], "inspect": ["browse", "buy"], "buy": ["browse"]}
EXPECTED = ["browse", "inspect", "buy"]
STEPS_SQL = f"""WITH {FRAMES}, s AS (SELECT *, CASE WHEN confidence < 0.2 THEN NULL WHEN label = 'view' THEN 'browse' WHEN label = 'click' THEN 'inspect' WHEN label = 'purchase' THEN 'buy' END AS c FROM frames),
g AS (SELECT *, CASE WHEN frame_index > 1 AND c IS NOT DISTINCT FROM lag(c) OVER (PARTITION BY case_id ORDER BY frame_index) THEN 0 ELSE 1 END AS n FROM s), i AS (SELECT *, sum(n) OVER (PARTITION BY case_id ORDER BY frame_index) AS i FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, i ORDER BY frame_index) AS r FROM i), t AS (SELECT *, CASE WHEN c IS NOT NULL AND r >= 3 THEN c END AS step FROM r),
p AS (SELECT *, coalesce(last_value(step IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'idle') AS p FROM t),
steps AS (SELECT case_id, step, frame_index, t_ms, p AS from_step FROM p WHERE step IS NOT NULL AND step <> p) """


def _steps(spark: SparkSession, d: str) -> DataFrame:
    candidate = F.element_at(F.create_map(*[F.lit(x) for kv in STEP_OF.items() for x in kv]), F.col("label"))
    x = frames(spark, d).withColumn("candidate", F.when(F.col("confidence") >= 0.2, candidate))
    return D.dwell(x, "case_id", "frame_index", "t_ms", "candidate", 3, "idle")


@query(STEPS_SQL + "SELECT case_id, step, frame_index, t_ms FROM steps")
def procedure_steps(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).withColumn("frame_index", F.col("frame_index").cast("long"))


@query(
    STEPS_SQL
    + """, v AS (SELECT *, list(step) OVER (PARTITION BY case_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visited FROM steps),
x AS (SELECT case_id, step, frame_index, from_step, coalesce(list_contains(CASE from_step WHEN 'idle' THEN ['browse'] WHEN 'browse' THEN ['inspect'] WHEN 'inspect' THEN ['browse', 'buy'] WHEN 'buy' THEN ['browse'] END, step), false) AS legal,
NOT list_has_all(coalesce(visited, []), CASE step WHEN 'browse' THEN []::VARCHAR[] WHEN 'inspect' THEN ['browse'] WHEN 'buy' THEN ['browse', 'inspect'] END) AS skipped FROM v) SELECT * FROM x WHERE NOT legal OR skipped"""
)
def unexpected_transitions(spark: SparkSession, d: str) -> DataFrame:
    x = D.step_checks(_steps(spark, d), "case_id", "frame_index", ALLOWED, EXPECTED, "idle").where("not legal or skipped")
    return x.select("case_id", "step", F.col("frame_index").cast("long").alias("frame_index"), "from_step", "legal", "skipped")


#: Stale after 5 s, confidence 0.3 at least, a key's cooldown in ms, spoken per minute (critical ones pass).
GATE = (5_000, 0.3, 20_000_000, 4)
GATE_SQL = f"""WITH RECURSIVE {FRAMES}, c AS (SELECT case_id, frame_index, event_id, t_ms, t_ms + (event_id % 7) * 1000 AS now_ms, label AS k, CASE WHEN label = 'error' THEN 'critical' ELSE 'notice' END AS priority, confidence FROM frames),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY frame_index) AS n FROM c),
g AS (SELECT case_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, ''::VARCHAR AS decision, []::BIGINT[] AS times, MAP([]::VARCHAR[], []::BIGINT[]) AS last FROM (SELECT DISTINCT case_id FROM c)
UNION ALL SELECT case_id, n, event_id, decision, CASE WHEN decision = 'spoken' THEN list_append(times, now_ms) ELSE times END, CASE WHEN decision = 'spoken' THEN map_concat(last, MAP([k], [now_ms])) ELSE last END
FROM (SELECT g.case_id, o.n, o.event_id, o.now_ms, o.k, g.times, g.last, CASE WHEN o.now_ms - o.t_ms > 5000 THEN 'stale' WHEN o.confidence < 0.3 THEN 'low_confidence'
WHEN o.now_ms - g.last[o.k] < 20000000 THEN 'cooldown' WHEN o.priority <> 'critical' AND len(list_filter(g.times, lambda t: o.now_ms - t < 60000)) >= 4 THEN 'rate_limited' ELSE 'spoken' END AS decision
FROM g JOIN o ON o.case_id = g.case_id AND o.n = g.n + 1)) """


def _gate(spark: SparkSession, d: str) -> DataFrame:
    c = frames(spark, d).select("case_id", "frame_index", "event_id", "t_ms", (F.col("t_ms") + F.col("event_id") % 7 * 1000).alias("now_ms"), F.col("label").alias("key"), F.when(F.col("label") == "error", "critical").otherwise("notice").alias("priority"), "confidence", F.lit(False).alias("is_answer"))
    return E.gate(c, "case_id", ["frame_index", "event_id"], *GATE)


@query(GATE_SQL + "SELECT case_id, event_id, decision FROM g WHERE n > 0")
def speak_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).select("case_id", "event_id", "decision")


@query(GATE_SQL + "SELECT decision, count(*) AS n FROM g WHERE n > 0 GROUP BY 1")
def gate_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
