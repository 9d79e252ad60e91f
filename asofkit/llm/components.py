"""Distributed connected components: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), component being the smallest node reachable.

    Each round points nodes to smaller neighbours; it ends when no edge changes, after about log(longest path) rounds.
    Edges are written to the shared folder each round, so that lost executors cost one round at most, and the round
    before is deleted. Loops and
    repeated edges do no harm; an empty table gives no rows.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: neighbours larger than a node point to the least of its neighbourhood.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node with very many neighbours is looked up by broadcast, so its links spread over tasks.
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_spread(both, least, "a", "n", "m").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours point to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(step, "edges")
        same = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        done = after.agg(F.count("*"), same).first() == now.agg(F.count("*"), same).first()
        discard(now, least)
        now = after
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
