"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (columns a, b; any duplicates and directions).

    ``component`` is the smallest node. Every step is two aggregations and joins by node, whose hot
    keys are combined on the map side or split by the adaptive join, and is written to the shared
    folder; the number of steps grows with the logarithm of the longest chain.
    """
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    state, step = _state(edges), 0
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), f"{name}-large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        new = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step + 1}")
        scratch.drop(f"{name}-large-{step}", f"{name}-{step}")
        now, edges, step = _state(new), new, step + 1
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges, to see a fixed point."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
