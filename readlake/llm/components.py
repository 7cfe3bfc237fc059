"""Connected components of an edge table by alternating star contraction, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import written


def _contract(edges: DataFrame, name: str) -> DataFrame:
    """One large-star and one small-star step; minima are aggregated before any join, so hubs cost no large group."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # large star: every larger neighbour of u is tied to u's minimum
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: u and its smaller neighbours are tied to the least of them (u > v holds in every row here)
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return written(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of at least one edge; root is the smallest node of its component.

    Loops and repeated edges do no harm; an empty table gives an empty result. Rounds grow with the logarithm of the
    longest path.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now, seen = written(now, "edges"), None
    while True:
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first())
        if sign == seen or not sign[0]:
            break
        seen, now = sign, _contract(now, "star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
