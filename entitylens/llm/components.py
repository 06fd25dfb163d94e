"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylens.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component. edges: (a, b) of long, a != b.

    Each round hangs larger neighbours, then smaller ones, on the least node in
    sight; a node with many neighbours is only ever a group key of sums. Rounds
    end when all edges lead to roots, after about the logarithm of the longest path.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that both sides of the join are plain exchanges and Spark can split the partition of a hot root.
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least-neighbours")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, stored(hung, "edges")
        discard(before, least)
        # Equal edges have equal sums of hashes.
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
