"""Connected components by rounds of joins; no edge or label ever comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _store


def components(edges: DataFrame, space: _store.Workspace) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges`` (a long, b long).

    Each round takes the smallest label among neighbours and then the label's own label; the sum of labels
    falls until nothing changes.  Every join reads written tables, so hubs can be split.
    """
    both = space.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "both")
    labels = space.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    total = None
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        lower = space.table(labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label")), "lower")
        other = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = space.table(lower.join(other, "label").select("node", F.least("label", "next").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total or now is None:
            return labels
        total = now
