"""Connected components by minimum labels with pointer jumping, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.session import cut


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the least node reachable.

    Each round takes the least label among a node and its neighbours, then the
    label of that label; labels halve their distance to the least one. Rounds
    are cut through the shared folder; only a count of changes reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), light=True)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = cut(low.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), light=True)
        if fresh.where("old <> label").isEmpty():
            return fresh.select("node", F.col("label").alias("component"))
        labels = fresh.select("node", "label")
    raise RuntimeError("components did not settle")
