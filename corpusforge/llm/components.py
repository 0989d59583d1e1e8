"""Connected components over an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node it can reach.

    Each round every node takes the least label among its neighbours, and then the label of
    its label; the rounds end when nothing changes, after about the logarithm of the longest
    path.  Nodes may be of any type that can be ordered.  A node that many others are linked
    with is one key of a join of two written tables, whose large side Spark can split.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        least = labels.union(near).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        least = least.join(up, "label").select("node", F.least("label", "higher").alias("label"))
        new = written(least)
        old = labels.withColumnRenamed("label", "before")
        changed = new.join(old, "node").where("label != before").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels
