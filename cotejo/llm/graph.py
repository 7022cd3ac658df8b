"""Connected components of a link table, in Spark joins with a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.plans.staging import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every node that a link names, and the smallest node it reaches. Each round takes the smallest label
    among a node's neighbours and then the label of that label, so long chains shorten by doubling."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = staged(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("low"))
                    .select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("was"),
                                                               F.least("root", "low").alias("root"))
        step = staged(step, "labels-step")
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("far"))
        labels_ = staged(step.join(jump, step.root == jump.at)
                         .select("node", "was", F.least("root", "far").alias("root")), "labels")
        if labels_.filter("was <> root").isEmpty():
            return labels_.select("node", "root")
        labels = labels_.select("node", "root")
