"""Connected components of an edge table, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so
    a path's length halves; it ends when no label changes. Lineage is cut in each round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both = written(both)
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        closer = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "near").alias("closer"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("closer"), F.col("component").alias("root"))
        after = written(closer.join(jump, "closer").select("node", F.least("closer", "root").alias("component"), (F.least("closer", "root") != F.col("was")).alias("changed")))
        labels = after.select("node", "component")
        if not after.where("changed").limit(1).count():
            return labels
