"""Graphs given as edge tables: reachability, taint, cycles. Iterative joins, each round checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's checkpoint folder; where none is set (tests), in the warehouse."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        spark: SparkSession = df.sparkSession
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge or more; cycles end when nothing new appears.

    Paths double in length each round. Use it where the result is wanted: its size is that of all reachable pairs.
    """
    all_ = cut_lineage(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    size = all_.count()
    while True:
        more = all_.alias("a").join(all_.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        all_ = cut_lineage(all_.union(more).distinct())
        new = all_.count()
        if new == size:
            return all_
        size = new


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): nodes that the seeds (node) reach along src -> dst, with the smallest number of edges; seeds are 0."""
    found = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = found, 0
    while True:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        front = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            return found
        found = cut_lineage(found.union(front))


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): each seed (node), with itself and every node that it reaches along src -> dst. Only paths from the seeds are followed."""
    found = cut_lineage(seeds.select("node").distinct()).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    steps = cut_lineage(edges.select(F.col("src").alias("__from"), F.col("dst").alias("__to")).where("src is not null and dst is not null").distinct())
    front = found
    while True:
        step = front.join(steps, F.col("dst") == F.col("__from")).select("src", F.col("__to").alias("dst")).distinct()
        front = cut_lineage(step.join(found, ["src", "dst"], "left_anti"))
        if front.isEmpty():
            return found
        found = cut_lineage(found.unionByName(front))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst) edges that remain after nodes without incoming or outgoing edges are peeled off, again and again.

    Empty if and only if the graph has no cycle; what remains lies on cycles or between them.
    """
    rest = cut_lineage(edges.select("src", "dst").distinct())
    size = rest.count()
    while size:
        inner = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        rest = cut_lineage(inner)
        new = rest.count()
        if new == size:
            break
        size = new
    return rest
