"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; equal marks mean that nothing changed."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges (a, b)``; a component is its smallest node.

    Each round points neighbours to the smallest node around: a large star the larger
    neighbours, a small star the others.  The rounds grow with the logarithm of the longest
    path; hubs are met by aggregates before joins, never by lists.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a != b").distinct())
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = staged(small.where("a != b").distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
