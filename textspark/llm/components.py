"""Connected components with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b), both bigint: label is the component's smallest node.

    Each round every node and its current root take the least root among the node's neighbours (a grouped
    minimum, so a hub's edges meet only as partial minima), then roots are followed one step (pointer
    jumping). The rounds needed grow with the logarithm of a component's diameter. Each round's labels are
    a table in the shared folder; the driver sees one number a round."""
    both = edges.filter("a != b").select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("far")), "b").groupBy("a").agg(F.min("far").alias("far"))
        offered = near.join(labels, near.a == labels.node).select("node", "label", "far")
        hooks = offered.select("node", "far").unionByName(offered.select(F.col("label").alias("node"), "far")).groupBy("node").agg(F.min("far").alias("far"))
        hooked = labels.join(hooks, "node", "left").select("node", "label", F.least("label", F.coalesce("far", "label")).alias("root"))
        roots = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(hooked.join(roots, "root").select("node", F.col("label").alias("before"), F.least("root", "next").alias("label")), "labels")
        changed = new.filter("before != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
