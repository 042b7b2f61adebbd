"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import durable, hot_keys, join_hot


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that can be reached.

    Every round each node takes the smallest label around it, then its label's label, so that labels spread in
    ever longer steps. Rounds go on until no label changes; only that count comes to the driver. A node with a large
    share of all edges, and a label with a large share of all nodes, are looked up in a broadcast table (join_hot).
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both, "b")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    labels = durable(labels)
    while True:
        near = join_hot(both, labels.withColumnRenamed("node", "b"), "b", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        step = durable(step)
        via = step.select(F.col("node").alias("component"), F.col("component").alias("via"))
        nxt = durable(join_hot(step, via, "component", "left").select("node", "was", F.least("component", F.coalesce("via", "component")).alias("component")))
        labels = nxt.select("node", "component")
        if not nxt.where("was <> component").limit(1).count():
            return labels
