"""Connected components of a link table, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: (a long, b long). A row (node, label) for each node of a link; label is the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so chains shrink to half
    their length or less a round. Every round is written to the shared folder, which ends its lineage.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), f"{name}-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = materialize(closer.join(above, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "old"), f"{name}-labels")
        changed = after.where("label <> old").take(1)
        labels = after.select("node", "label")
        if not changed:
            return labels
