"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm._scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); label is the least node of its component.

    Each round hangs all larger neighbours, then all smaller ones, below a
    node's least neighbour (large star, small star); the number of rounds is
    logarithmic in the longest path. The edges are written each round, so no
    plan grows and a lost executor costs one round. Only two numbers a round
    reach the driver. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "stars")
    was = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = written(small, "stars")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if was == state:
            break
        was = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
