"""Connected components of an edge table by contraction.

Each round every vertex takes the smallest of itself and its neighbours, by a
hash that changes from round to round, as its representative; the edges are
rewritten to representatives and loops and repeats dropped.  Vertices shrink
by a constant factor a round, whatever the shape, and a hub costs one
aggregate that combines before the shuffle.  Each round is written durably.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codesift.session import durable, durable_counted


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``edges(a bigint, b bigint)``."""
    labels, seed = None, 0
    edges, n = durable_counted(edges.where("a <> b").distinct())
    while n:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("v"))
        best = ends.groupBy("a").agg(F.min(key("b")).alias("m"))
        best = durable(best.select(F.col("a").alias("v"), F.least("m", key("a"))["v"].alias("r")))
        if labels is None:
            labels = best.select("v", F.col("r").alias("root"))
        else:
            step = best.select(F.col("v").alias("root"), "r")
            labels = labels.join(step, "root", "left").select("v", F.coalesce("r", "root").alias("root"))
        labels = durable(labels)
        left = best.select(F.col("v").alias("a"), F.col("r").alias("ra"))
        right = best.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges, n = durable_counted(moved.distinct())
        seed += 1
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
