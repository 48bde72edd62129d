"""Connected components of a link table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with the least label reachable through links (a, b); labels are nodes.

    Each pass takes the least label of a node's neighbours, then the label of
    its label, so a chain shortens by doubling.  Links to unknown nodes and
    repeated links are harmless; a node without links keeps its label.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = cluster.checkpoint(
            step.join(up, "label", "left").select(
                "node", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("old")).alias("moved")
            )
        )
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
