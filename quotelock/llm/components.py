"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node with an edge; a component is its least node.

    ``edges`` has columns ``a`` and ``b``. Every node takes the least label around it, and
    then the label of its label, until nothing changes; minima are combined before each
    shuffle, so a hub with very many edges is no larger a group than any other.
    """
    both = staged(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "component-edges"
    )
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        around = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(around, "node").select("node", F.least("component", "near").alias("near"), "component")
        of_label = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = staged(
            lower.join(of_label, "near").select(
                "node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved")
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if not moved.where("moved").limit(1).count():
            return labels
