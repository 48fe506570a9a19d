"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of that label, so the rounds grow with the
    logarithm of a component's diameter.  Rounds are written tables.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                         .select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        told = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        head = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = materialize(step.join(head, "label").select("node", "old", F.least("label", "jump").alias("label")), "labels")
        if not labels.where("label < old").head(1):
            return labels.select("node", "label")
