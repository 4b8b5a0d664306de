"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import removed, shared_dir, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: root is the least node of its component.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the graph.
    Each step is two aggregations and joins on one node column; a hub's edges are reduced to their
    minimum before they are shuffled. The minima are written before they are joined, so that Spark may
    split a hub's edges over tasks. Every step is written to the shared folder. Edges with a null end and loops are ignored; the nodes are compared by order.
    """
    spark = edges.sparkSession
    base = shared_dir(spark, name)
    now = written(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        f"{base}/0",
    )
    step = 0
    while not _is_star(now):
        step += 1
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        least = written(least.select("x", F.least("x", "m").alias("m")), f"{base}/{step}-least")
        # Large star: larger neighbours go to the least node of the neighbourhood.
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        large = written(large, f"{base}/{step}-large")
        # Small star: smaller neighbours and the node itself go to the least of them.
        smallest = written(large.groupBy("v").agg(F.min("u").alias("m")), f"{base}/{step}-smallest")
        small = large.join(smallest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u")
        now = written(small.unionAll(smallest.select("v", F.col("m").alias("u"))).distinct(), f"{base}/{step}")
        for done in (f"{step}-least", f"{step}-large", f"{step}-smallest", f"{step - 1}"):
            removed(spark, f"{base}/{done}")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(roots)


def _is_star(edges: DataFrame) -> bool:
    """Whether every node but the roots has exactly one edge, to a root (edges run from v to a smaller u)."""
    ends = edges.select("v", F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select(F.col("u").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    worse = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down = 1 AND up = 1)")
    return worse.isEmpty()
