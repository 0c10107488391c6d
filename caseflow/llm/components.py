"""Connected components by distributed union-find, and links found in shared lists.

Each task first joins the edges that it holds by union-find in memory; what is left are stars within tasks. Up to LOCAL_EDGES of
them, a fixed number, one task joins as it would any block of edges. Of more,
alternating large-star and small-star rounds, each a minimum by key and a join, which adaptive execution may split, join
the stars of different tasks; their number grows with the logarithm of the longest path between tasks. No group is ever gathered. Each
round is written to the shared folder, so lineage stays short, and replaces the one before. The test for the end is an aggregate by
node: no node has two parents, and no parent has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

#: Edges that a task joins in memory at a time.
LOCAL_EDGES = 1 << 20
#: Members of a list's largest component that every other member of the list is held against before the rest is looked at.
LEADERS = 8


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes of these edges that are not the smallest themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:  # every path ends at its root
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    low = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[low], nodes[parent[low]]


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def _is_forest_of_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("node"), "v", F.lit(False).alias("parent")).union(e.select("v", F.lit(None).cast("long"), F.lit(True)))
    by = ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("parent").alias("parent"))
    return by.where("lo != hi or (lo is not null and parent)").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has a smaller one in its component, and the component's smallest node.

    edges: (u, v) of longs, undirected; repeated edges and loops are fine, null ends are left out. Smallest nodes
    themselves and nodes without edges have no row.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u != v")
    e = C.written(e.mapInArrow(_locally, "u long, v long").distinct(), "edges")
    left = e.count()
    if left <= LOCAL_EDGES:  # no more than any task joins in memory at a time: done in one go, without rounds of jobs
        before, e = e, C.written(e.coalesce(1).mapInArrow(_locally, "u long, v long"), "edges")
        C.dropped(before)
        return e
    # as few tasks as hold the edges: the more edges a task joins, the fewer rounds follow; beyond the session's partitions nothing is joined up
    tasks = max(e.sparkSession.sparkContext.defaultParallelism, -(-left // LOCAL_EDGES))
    while not _is_forest_of_stars(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = small.union(low.select("u", F.col("m").alias("v"))).coalesce(tasks).mapInArrow(_locally, "u long, v long").distinct()
        before, e = e, C.written(joined.coalesce(tasks), "edges")
        C.dropped(before)
    return e


def linked(lists: DataFrame, verified: Callable[[DataFrame], DataFrame], fits: Column) -> DataFrame:
    """Components, as in roots(), of all verified links between nodes that share a list.

    lists: (token, node long, a), a being a struct of what `fits`, a predicate over ax and ay, looks at; it must hold for every
    link, and only pairs for which it holds leave a join. verified() takes distinct pairs (x, y) and returns those that are links as (u, v).

    Three steps, none of which gives out the pairs of a group that is one component already: (1) each member of a
    list with the list's leader, by a hash of the node, so that all lists of a group tend to one leader, which settles lists of two; (2) members
    outside the list's largest component with LEADERS members inside, which a hash of token and node chooses; (3) the rest, exactly:
    members outside the largest component with members of other components. What (3) rejects is no
    link, so no link between different components is left.
    """

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select(F.col("token").alias(f"t{s}"), F.col("node").alias(s), F.col("a").alias(f"a{s}"), F.col("comp").alias(f"c{s}"))

    def grown(before: DataFrame | None, left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = side(left, "x").join(side(right, "y"), (F.col("tx") == F.col("ty")) & (F.col("cx") != F.col("cy")) & fits)
        links = C.written(verified(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()), "links")
        out = roots(links if before is None else links.union(before))
        C.dropped(links, *([] if before is None else [before]))
        return out

    def leaders(rows: DataFrame, rank: Column, *by: str) -> DataFrame:
        return rows.groupBy("token", *by).agg(F.min_by(F.struct("node", "a", "comp"), rank).alias("l")).select("token", "l.*")

    def parted(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(all, inside, outside): lists with components, by whether the component has the most members of the list."""
        own = wide.join(links.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        own = C.written(own, "labelled")
        sizes = own.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
        largest = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("comp"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("comp").alias("largest"))
        mixed = own.join(largest, "token")
        return own, mixed.where("comp = largest"), mixed.where("comp != largest")

    own = lists.withColumn("comp", F.col("node"))
    links = grown(None, own, leaders(own, F.xxhash64("node")))
    # the only pair of a list of two has been looked at
    wide = C.written(lists.join(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("token"), "token"), "wide")
    own, inside, outside = parted(links)
    rank = F.xxhash64("node", "token")
    links = grown(links, outside, leaders(inside.withColumn("slot", F.pmod(rank, F.lit(LEADERS))), rank, "slot"))
    C.dropped(own)
    own, inside, outside = parted(links)
    links = grown(links, outside, inside.union(outside))
    C.dropped(own, wide)
    return links
