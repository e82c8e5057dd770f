"""Connected components by minimum labels with pointer jumping, each round's labels written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, label): the smallest node that a node reaches. Nodes without an edge are not listed."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b"), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # jump: a node takes the label its label had; labels are nodes, too
        step = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = written(step, "cc-labels")
        if not new.where("old <> label").take(1):
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"no end after {most_rounds} rounds")
