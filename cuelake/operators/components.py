"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.staging import written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of links (a, b): label is the smallest node it is linked with.

    Each round takes the smallest label among neighbours, then that label's label, so that rounds grow
    with the logarithm of the longest chain. Rounds are joins of written tables; a node with very
    many links is a skewed key of a sort-merge join, its minimum is taken with partial aggregates.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before")), "labels")
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(lower.join(above, "label").select("node", F.least("label", "above").alias("label"), "before"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> before").isEmpty():
            return labels
