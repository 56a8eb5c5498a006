"""Connected components of an edge table, by alternating large-star and small-star steps.

A step takes a minimum for each node and joins it back; no neighbour list is
gathered, so a hub with most of the edges is a partial aggregate and a join that adaptive
execution may split. Edges are written to the shared folder after each round, so the
lineage stays short. Rounds end when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import discard, settle


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges u, v (long) -> node, component: the smallest node that it reaches. Nodes without edges don't appear."""
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = _digest(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", "m")).distinct()
        edges, old = settle(small), edges
        discard(old)
        now = _digest(edges)
        if now == last:
            break
        last = now
    low = edges.groupBy("u").agg(F.min("v").alias("component"))
    return low.select(F.col("u").alias("node"), "component").union(low.select(F.col("component").alias("node"), "component").distinct())
