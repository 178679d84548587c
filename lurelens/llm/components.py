"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for every node of an edge (``a``, ``b``).

    Alternates large-star and small-star steps until the edges form stars; the
    number of rounds grows with the logarithm of the longest chain.  Self-loops
    and repeated edges are allowed; nodes are longs, without nulls.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now = scratch.save(now, f"{label}-0")
    seen, k = None, 0
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.filter("u != v").distinct(), f"{label}-large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = scratch.save(small.filter("u != v").distinct(), f"{label}-{k + 1}")
        scratch.drop(f"{label}-large-{k}")
        scratch.drop(f"{label}-{k}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        k += 1
        if state == seen:
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        seen = state
