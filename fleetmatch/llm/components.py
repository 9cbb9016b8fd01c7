"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch.llm.store import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``a, b`` (any order, repeats allowed) -> ``node, component``: the smallest node reachable.

    Alternates large-star and small-star steps (a union-find by joins): every node is
    linked to the least node it sees until each group is one star.  Steps are grouped
    minima with map-side combining and a join back, which Spark splits where a star is
    hot; each round is written, and their number grows with the logarithm of the longest
    chain.  No group is gathered anywhere.
    """
    near = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    for _ in range(most):
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        near = written(small.filter("a <> b").distinct())
        now = near.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = near.select(F.col("b").alias("node")).distinct()
    return near.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
