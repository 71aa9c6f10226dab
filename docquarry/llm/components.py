"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import runtime


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of (a, b), long: component is the smallest node reachable.

    Star contraction: each round hangs every node's neighbours on its smallest neighbour, first the larger ones, then
    the smaller ones too; rounds follow until nothing changes, a few times the logarithm of the nodes. A node's
    smallest neighbour is found by an aggregation that combines before the shuffle, and joined back: a node's edges, as
    pairs of numbers, pass through one task of that join, but are never held there. Each round's edges are written to
    the shared folder."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = runtime.written(edges)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # a node whose neighbours are all smaller keeps its edges for the second half
        kept = now.join(least.select("a", "m"), "a").filter("m < a").select("a", F.col("m").alias("b"))
        half = large.unionAll(kept).filter("a <> b").distinct()
        low = half.groupBy("a").agg(F.min("b").alias("m"))
        small = half.join(low, "a").select("a", "b", "m")
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = runtime.written(after)
        # done when each node hangs on one other, which hangs on none
        ends = after.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(after.select("b", F.lit(0), F.lit(1)))
        odd = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
        runtime.dropped(now)
        now = after
        if odd.isEmpty():
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
