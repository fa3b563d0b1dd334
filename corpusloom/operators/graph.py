"""Connected components of an edge table, as joins and aggregations; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import handed_over


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node in edges (a, b).

    Labels fall to the least among the neighbours', then to the label of that label, until none changes: the rounds grow
    with the logarithm of the longest path, as a rule. An edge from a node to itself makes it a node."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = handed_over(both.distinct(), "edges")
    labels = handed_over(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = handed_over(stepped.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.filter("label != old").limit(1).count():
            return labels
