"""Connected components of a link table that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b): nodes that are linked directly or through others share their
    smallest node as label.

    Each round takes the smallest label among the neighbours and then the label of that label, so that the reach about
    doubles; the labels are stored after each round. A node with very many links reaches its task as one row per map
    task, and the joins are plain ones that adaptive execution can split.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        # the label of a label is never larger; a label is always a node of the table
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(
            least.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels"
        )
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels
