"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import lookup


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the component's smallest node.

    Labels fall to the smallest among neighbours, then jump to their label's
    label; both steps are partial minimum aggregates and joins that give a hub's
    neighbours its label by broadcast, so they never meet in one task.  The label
    table is written each round and the rounds grow with the logarithm of the
    longest path.
    """
    links = scratch.keep(edges.select("a", "b").where("a <> b").distinct())
    both = links.union(links.select("b", "a"))
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                          .select("node", F.least("node", "m").alias("root")))
    while True:
        told = (lookup(both, labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
                .union(labels).groupBy("node").agg(F.min("root").alias("root")))
        told = scratch.keep(told)
        jump = told.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nearer = scratch.keep(lookup(told, jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root")))
        same = labels.withColumnRenamed("root", "old").join(nearer, "node").where("old <> root").limit(1).count() == 0
        scratch.free(labels, told)
        labels = nearer
        if same:
            scratch.free(links)
            return labels
