"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root): the smallest node of each node's component; ``edges`` has a and b.

    Each round takes the least label among a node and its neighbours, then the
    label of that label.  Labels are written to shared storage every round, so a
    lost executor costs a re-read.  Only a count of changes reaches the driver.
    """
    both = stage(edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    labels = stage(labels)
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near")))
        lower = (labels.join(near, labels.node == near.a)
                 .select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("jump"))
        new = stage(lower.join(up, lower.root == up.up, "left")
                    .select("node", "old", F.least("root", F.coalesce("jump", "root")).alias("root")))
        labels = new.select("node", "root")
        if new.where("old != root").isEmpty():
            return labels
