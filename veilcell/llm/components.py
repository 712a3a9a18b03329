"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); a component is named by its smallest node.

    Each round takes the smallest label of the neighbours and then the label of
    that label, so long chains close in a logarithmic number of rounds. Self
    loops and repeated edges do no harm; no edges give no rows.
    """
    both = ws.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "neighbours")
    labels = ws.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = (labels.join(near, "node")
                .select("node", "component", F.least("component", "near").alias("next")))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = ws.cut(step.join(jump, "next").select("node", F.col("component").alias("before"),
                                                     F.least("next", "far").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("before <> component").isEmpty():
            return labels
