"""Connected components as joins and grouped minima over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges; ``root`` is the smallest node it is connected with.

    Each round takes the smallest label among a node's neighbours and then follows that label once
    (pointer jumping), so long chains need few rounds. The minima combine before
    the shuffle; a node with very many edges meets no single task.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).where(F.col("node") != F.col("to"))
    both = stored(both.union(both.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("to"), F.col("root").alias("near")), "to")
                .groupBy("node").agg(F.min("near").alias("near")))
        best = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(best.join(jump, "root", "left").select("node", "old", F.least(F.coalesce("next", "root"), "root").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return labels
