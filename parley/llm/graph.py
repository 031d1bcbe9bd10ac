"""Connected components by least labels, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parley.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node it is linked with.

    A round gives each node the least label among itself and its neighbours, then
    the label of that label; rounds end when no label falls. Every round is written
    to the checkpoint folder. A node with very many edges is a hot key of the join
    (which adaptive execution splits) and of a minimum (summed up before the shuffle).
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
                .join(labels, "node").select("node", F.least("near", "label").alias("label"), F.col("label").alias("old")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        labels = cut_lineage(seen.join(up, "label", "left").select("node", F.least("label", "higher").alias("label"), "old"), "labels")
        if labels.where("label < old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
