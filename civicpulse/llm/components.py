"""Connected components by alternating star steps, with hot nodes kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, Store


def neighbour_minimum(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))


def with_minimum(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the minimum of their node ``u``; nodes of many edges take theirs by broadcast.

    At most 1 / HOT_SHARE nodes hold that share of the edges, so the broadcast is bounded.
    """
    total = least.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= max(1000.0, HOT_SHARE * total)
    hot = F.broadcast(least.where(is_hot).select("u", F.col("m").alias("hot_m")))
    marked = edges.join(hot, "u", "left")
    some = marked.where(F.col("hot_m").isNull()).drop("hot_m").join(least.where(~is_hot).drop("n"), "u")
    return some.select("u", "v", "m").unionByName(
        marked.where(F.col("hot_m").isNotNull()).select("u", "v", F.col("hot_m").alias("m")))


def components(edges: DataFrame, store: Store) -> DataFrame:
    """``node, component`` for every node of the undirected ``edges`` (columns ``a, b``).

    ``component`` is the least node that can be reached.  Large-star and small-star steps
    alternate until every edge points at its component; the rounds grow with the logarithm
    of the longest chain.  Each round is written, so lost executors repeat one round at
    most.  Loops and repeated edges do no harm; no edges give no rows.
    """
    now = store.put(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: a node's larger neighbours move to the least of its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.put(neighbour_minimum(both))
        large = store.put(with_minimum(both, least).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours move to the least of them.
        fewest = store.put(neighbour_minimum(large))
        starred = with_minimum(large, fewest)
        small = store.put(starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            fewest.select("u", F.col("m").alias("v"))).distinct())
        # Done when no node has two edges and none is both start and end of edges.
        ends = small.select(F.col("v").alias("u")).distinct()
        unsettled = small.join(ends, "u", "left_semi").limit(1).count() + small.groupBy("u").count().where(
            "count > 1").limit(1).count()
        store.drop(now, least, large, fewest)
        now = small
        if not unsettled:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
