"""Recovery of withheld moments: a customer is a run, a day a second; every third order is a reference frame, its year the moment, the dear ones are supplied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import gaps as G
from caseflow.plans.registry import query, spread, table

TOLERANCE, MOST, DURATION = 20_000, 80_000, 10_000_000

GAPS = f"""o AS (SELECT o_custkey AS run, o_orderkey AS f, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) * 1000 AS t, year(o_orderdate)::INT AS y, o_totalprice AS p FROM orders),
m AS (SELECT run, y AS moment, f, t FROM o WHERE f % 3 = 0), mis AS (SELECT DISTINCT run, moment FROM m EXCEPT SELECT DISTINCT m.run, moment FROM m JOIN o USING (run, f) WHERE p > 300000),
s AS (SELECT run, f % 2 AS round, f AS search, t - 30000 AS a, t + 30000 + f % 5 * 10000 AS b FROM o WHERE f % 7 IN (1, 2)),
ask AS (SELECT DISTINCT s.run, round, search, m.moment FROM s JOIN m USING (run) JOIN mis ON mis.run = m.run AND mis.moment = m.moment WHERE b - a <= {MOST} AND a <= least({DURATION}, m.t + {TOLERANCE}) AND b >= greatest(0, m.t - {TOLERANCE})),
ret AS (SELECT s.run, s.round, s.search, o.f, o.t FROM s JOIN o ON o.run = s.run AND o.t BETWEEN a AND b AND o.f % 4 <> 2),
dec AS (SELECT DISTINCT run, 1 AS round, f, t, CASE WHEN f % 4 = 3 THEN 'drop' ELSE 'keep' END AS d FROM ret WHERE round = 0),
near AS (SELECT x.run, x.f, count(DISTINCT m.moment) AS n, min(m.moment) AS moment FROM (SELECT DISTINCT run, f, t FROM ret) x JOIN m ON m.run = x.run AND abs(m.t - x.t) <= {TOLERANCE} GROUP BY 1, 2),
mat AS (SELECT DISTINCT r.run, r.f, CASE WHEN m.f IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'temporal_proxy' END AS kind, coalesce(m.moment, near.moment) AS moment FROM ret r LEFT JOIN m ON m.run = r.run AND m.f = r.f LEFT JOIN near ON near.run = r.run AND near.f = r.f),
good AS (SELECT mat.* FROM mat JOIN mis USING (run, moment) WHERE kind IS NOT NULL),
back AS (SELECT DISTINCT r.run, r.round, kind, moment FROM ret r JOIN good g ON g.run = r.run AND g.f = r.f),
rounds AS (SELECT run, min(round) AS lo, max(round) AS hi FROM (SELECT run, round FROM s UNION ALL SELECT run, round FROM dec) GROUP BY 1),
kept AS (SELECT DISTINCT d.run, kind, moment FROM dec d JOIN rounds r ON r.run = d.run AND d.round = r.hi JOIN good g ON g.run = d.run AND g.f = d.f WHERE d.d = 'keep'),
found AS (SELECT a.run, 'initial_requested' AS stage, moment FROM ask a JOIN rounds r ON r.run = a.run AND a.round = lo UNION ALL SELECT run, 'cumulative_requested', moment FROM ask
UNION ALL SELECT run, 'cumulative_retrieved', moment FROM back UNION ALL SELECT run, 'cumulative_retrieved_' || kind, moment FROM back UNION ALL SELECT run, 'final_retained', moment FROM kept UNION ALL SELECT run, 'final_retained_' || kind, moment FROM kept)"""
_STAGES = "['initial_requested', 'cumulative_requested', 'cumulative_retrieved', 'cumulative_retrieved_exact', 'cumulative_retrieved_temporal_proxy', 'final_retained', 'final_retained_exact', 'final_retained_temporal_proxy']"


def _session(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long") * 1000
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("frame_id"), t.alias("t_ms"), F.year("o_orderdate").alias("moment_id"), F.col("o_totalprice").alias("p"))
    o = spread(o, "run")
    members = o.where("frame_id % 3 = 0").select("run", "moment_id", "frame_id", "t_ms")
    s = o.where("frame_id % 7 in (1, 2)").select("run", (F.col("frame_id") % 2).alias("round"), F.col("frame_id").alias("search"), (F.col("t_ms") - 30_000).alias("start_ms"), (F.col("t_ms") + 30_000 + F.col("frame_id") % 5 * 10_000).alias("end_ms"))
    back = s.join(o.where("frame_id % 4 != 2"), "run").where("t_ms between start_ms and end_ms").select("run", "round", "search", "frame_id", "t_ms")
    decision = F.when(F.col("frame_id") % 4 == 3, "drop").otherwise("keep")
    decisions = back.where("round = 0").select("run", F.lit(1).cast("long").alias("round"), "frame_id", "t_ms", decision.alias("decision")).distinct()
    return {"runs": o, "members": members, "supplied": o.where("p > 300000").select("run", "frame_id"), "searches": s, "retrieved": back, "decisions": decisions}


@query(
    f"""WITH {GAPS}, n AS (SELECT run, stage, count(DISTINCT moment) AS n FROM found GROUP BY 1, 2), w AS (SELECT run, unnest({_STAGES}) AS stage, coalesce(d, 0) AS d FROM (SELECT DISTINCT run FROM o) LEFT JOIN (SELECT run, count(*) AS d FROM mis GROUP BY 1) USING (run))
SELECT run, stage, coalesce(n, 0) AS count, d AS denominator, CASE WHEN d > 0 THEN coalesce(n, 0) / d END AS recall FROM w LEFT JOIN n USING (run, stage)"""
)
def gap_rates(spark: SparkSession, d: str) -> DataFrame:
    """What share of each run's missing moments was asked for, came back, and was kept."""
    t = _session(spark, d)
    return G.rates(t["runs"], t["members"], t["supplied"], t["searches"], t["retrieved"], t["decisions"], TOLERANCE, F.lit(DURATION), MOST)


@query(
    f"""WITH {GAPS}, a AS (SELECT run, moment, min(round) AS round FROM ask GROUP BY 1, 2), b AS (SELECT run, moment, min(round) AS round FROM back GROUP BY 1, 2), r AS (SELECT DISTINCT run, round FROM (SELECT run, round FROM s UNION ALL SELECT run, round FROM dec))
SELECT run, round, (SELECT count(*) FROM a WHERE a.run = r.run AND a.round <= r.round) AS requested, (SELECT count(*) FROM b WHERE b.run = r.run AND b.round <= r.round) AS retrieved FROM r"""
)
def gap_progress(spark: SparkSession, d: str) -> DataFrame:
    """Missing moments asked for and come back by the end of each round."""
    t = _session(spark, d)
    return G.progress(t["members"], t["supplied"], t["searches"], t["retrieved"], t["decisions"], TOLERANCE, F.lit(DURATION), MOST)


@query(
    f"""WITH {GAPS}, z AS (SELECT run, a, b, max(b) OVER (PARTITION BY run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), c AS (SELECT run, count(*) AS requests, count(*) FILTER (b - a > {MOST}) AS broad, sum(b - a)::BIGINT AS summed_ms, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::BIGINT AS union_ms FROM z GROUP BY 1),
r AS (SELECT run, count(*) AS returned, count(DISTINCT f) AS returned_distinct FROM ret GROUP BY 1)
SELECT run, coalesce(requests, 0) AS requests, coalesce(broad, 0) AS broad, coalesce(summed_ms, 0) AS summed_ms, coalesce(union_ms, 0) AS union_ms, coalesce(returned, 0) AS returned, coalesce(returned_distinct, 0) AS returned_distinct FROM (SELECT DISTINCT run FROM o) LEFT JOIN c USING (run) LEFT JOIN r USING (run)"""
)
def gap_cost(spark: SparkSession, d: str) -> DataFrame:
    """What each run's searches cost: how many, how many too broad, their time in sum and in union, frames returned and different ones."""
    t = _session(spark, d)
    return G.cost(t["runs"], t["searches"], t["retrieved"], MOST)
