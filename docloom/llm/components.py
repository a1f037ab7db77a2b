"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, hot_keys, join_hot


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the least node of its component. Each round, a node takes the least of its own
    label, its neighbours' and its label's; rounds double the distance that labels travel along stars. Labels
    are written to the shared folder each round; no node's neighbours, and no component, are ever gathered in one row or one task: what
    is joined by a neighbour or a label that many rows share is joined with a broadcast of those few."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = cut(both.union(both.select("near", "node")).where("node != near").distinct(), "edges")
    hubs = hot_keys(cut(both.groupBy("near").agg(F.count("*").alias("n")), "degrees"), "near", "n")
    labels = cut(both.groupBy("node").agg(F.least(F.first("node"), F.min("near")).alias("root")), "labels")
    while True:
        seen = join_hot(both, labels.select(F.col("node").alias("near"), F.col("root").alias("seen")), "near", hubs, "inner")
        step = labels.join(seen.groupBy("node").agg(F.min("seen").alias("seen")), "node")
        step = cut(step.select("node", "root", F.least("root", "seen").alias("next")), "labels")
        crowd = hot_keys(cut(labels.groupBy("root").agg(F.count("*").alias("n")), "crowds"), "root", "n")
        step = join_hot(step, labels.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", crowd)
        step = cut(step.select("node", F.col("root").alias("old"), F.least("next", F.coalesce("up", "next")).alias("root")), "labels")
        labels = step.select("node", "root")
        if step.where("old != root").isEmpty():
            return labels
