"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.session import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest
    node that links reach.

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, so chains shrink fast; links and labels are written
    tables, and rounds end when no label changes.  A hub's neighbours are
    reduced by partial minima before the shuffle.
    """
    both = scratch.cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = scratch.cut(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = scratch.cut(labels.join(near, "node").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("was")), "step")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        new = scratch.cut(step.join(jump, "root").select("node", F.col("jump").alias("root"), "was"), "labels")
        if not new.where("root <> was").take(1):
            return new.select("node", "root")
        labels = new.select("node", "root")
