"""Connected components by joins, for graphs that fit no task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(edges: DataFrame, key: str) -> DataFrame:
    """key, v, label (the least vertex of its component) of every vertex of ``edges`` (key, a, b), apart by ``key``.

    Large and small stars in turn: every vertex ties its greater, then its smaller neighbours to the least of them, until all
    hang on the least of their component. A round is two aggregations and two joins on vertices; rounds grow with the logarithm of the size.
    """
    e = edges.select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = cut(e), None
    while True:
        both = e.unionByName(e.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(key, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        joined = large.join(least, [key, "u"])
        small = joined.select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select(key, "u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64(key, "u", "v"))).first())
        if now == before:
            break
        before = now
    return e.select(key, F.col("u").alias("v"), F.col("v").alias("label")).unionByName(e.select(key, "v", F.col("v").alias("label")).distinct())
