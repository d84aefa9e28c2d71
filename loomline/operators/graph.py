"""Groups of matches: connected components and what is reported of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import checkpointed


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, group_key): the least node of each node's component; nodes without an edge to another are left out.

    Labels take the least label of their neighbours, then jump to their label's
    label; each round is checkpointed, and only a count reaches the driver.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    e = checkpointed(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = checkpointed(labels)
    while True:
        near = e.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("next"), "label")
        jump = step.alias("s").join(step.select(F.col("u").alias("at"), F.col("next").alias("far")).alias("t"), F.col("s.next") == F.col("t.at"))
        step = checkpointed(jump.select("s.u", F.least("s.next", "t.far").alias("next"), "s.label"))
        changed = step.filter("next <> label").limit(1).count()
        labels = step.select("u", F.col("next").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("group_key"))


def groups(matches: DataFrame, src: str, dst: str) -> DataFrame:
    """Per component: group_key, members (sorted), n_members, n_matches, best similarity."""
    nodes = components(matches, src, dst)
    edges = matches.filter(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("x"), F.greatest(src, dst).alias("y")).agg(F.max("similarity").alias("similarity"))
    per = edges.join(nodes, edges["x"] == nodes["node"]).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_matches"), F.max("similarity").alias("best"))
    members = nodes.groupBy("group_key").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("n_members"))
    return members.join(per, "group_key").select("group_key", "members", "n_members", "n_matches", "best")
