"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each step is an aggregation and a join, so a hub is pre-aggregated and a skewed join can be split;
    no component is gathered anywhere. The number of steps grows with the logarithm of the longest
    path. Self-loops and repeated edges change nothing; an empty table gives no rows.
    """
    low = F.least("a", "b").alias("a")
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("b"), low).distinct(), narrow=True)
    before = None
    while True:
        hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(hashed)).first())  # of the set of edges
        if mark == before or not mark[0]:
            break
        before = mark
        # large star: larger neighbours of u go to u's smallest neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        moved = small.where("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
        now = checkpoint(moved.unionAll(least.select("b", F.col("m").alias("a"))).distinct(), narrow=True)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
