"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one aggregate (the least neighbour of every node) and one equi-join, so a node with very
many links costs no more than its rows; the aggregate is stored first, so that Spark may split that join's
large partitions where such a node's links meet. After each pair of steps the links are written to the shared
folder and the former ones removed. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _least(links: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours in `links` (u, v)."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order, repeats and loops allowed -> (node, component): the least node reachable."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = stored(_least(both))
        large = both.join(first, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        former, edges = edges, stored(small.filter("u <> v").distinct())
        discard(former, first)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
