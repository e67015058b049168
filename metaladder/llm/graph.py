"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def closed(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) form stars: no ``u`` has a second edge, as ``u`` or as ``v``."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))))
    return not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).filter("ups > 0 and n > 1").agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame, base: str) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of an edge.

    ``edges`` has long columns ``a`` and ``b``. Loops and repeated edges are allowed; nodes
    without edges to others do not occur in the result; an empty table gives an empty result.
    Each round is written to the workspace; the first that leaves nothing but stars is the
    last. Rounds grow with the logarithm of the longest chain. No node's neighbours are ever
    gathered in one row: minima are partial aggregates and hot nodes meet them in a join that
    adaptive execution can split.
    """
    spark = edges.sparkSession
    now = storage.materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), base, "edges-0")
    turn = 0
    while not closed(now):
        turn += 1
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = storage.materialise(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), base, f"least-{turn}")
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # The node itself and each smaller neighbour are tied to the smallest of them.
        ties = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(lowest, "u").select(F.inline(ties)).filter("u <> v").distinct()
        now = storage.materialise(small, base, f"edges-{turn}")
        storage.drop(spark, f"{base}/edges-{turn - 1}", f"{base}/least-{turn}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
