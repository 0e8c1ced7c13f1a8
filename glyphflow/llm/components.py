"""Connected components by contraction: every round maps each vertex to the first of its neighbourhood in a hashed order.

The hashed order makes long sorted chains shrink by a constant factor per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """v, label for every vertex of ``edges`` (a, b longs); label is the smallest vertex of its component.

    Each round cuts its lineage with a written table. The maps of all rounds are composed from the last to the first, and
    every component is then named after its smallest vertex.
    """
    maps = []
    left = edges.select("a", "b").where("a <> b").distinct()
    while True:
        left = scratch.keep(left)
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.select("a", F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v")).alias("m")).groupBy("a").agg(F.min("m").alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        step = scratch.keep(first.select(F.col("a").alias("v"), F.least(own, F.col("m"))["v"].alias("label")))
        maps.append(step)
        x = left.join(step.select(F.col("v").alias("a"), F.col("label").alias("la")), "a").join(step.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b")
        left = x.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label")).where("false")
    out = maps.pop()
    while maps:
        one = maps.pop()
        nxt = out.select(F.col("v").alias("label"), F.col("label").alias("final"))
        out = scratch.keep(one.join(nxt, "label", "left").select("v", F.coalesce("final", "label").alias("label")))
    least = out.groupBy("label").agg(F.min("v").alias("least"))
    return out.join(least, "label").select("v", F.col("least").alias("label"))
