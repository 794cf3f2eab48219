"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of edges (a, b); nulls and loops are ignored.

    Labels fall to the smallest label among the neighbours and then to that label's own label, until none
    changes. Every round is written once, so a lost executor repeats one round only.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    both = materialise(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("label"), F.lit(True).alias("changed")
        ),
        "labels",
    )
    while labels.where("changed").limit(1).count():
        known = labels.select("node", "label")
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("label").alias("near"))
        fallen = known.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = known.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = materialise(
            fallen.join(jump, "via").select(
                "node", F.col("far").alias("label"), (F.col("far") < F.col("old")).alias("changed")
            ),
            "labels",
        )
    return labels.select("node", F.col("label").alias("component"))
