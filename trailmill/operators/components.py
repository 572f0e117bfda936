"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.session import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) is connected with.

    Every round each node takes the least label around it, then the label of its label; chains
    shorten by half, so the rounds grow with the logarithm of the longest one. Nothing is
    gathered per node: a node with many links is reduced per task first. Each round is a table.
    """
    both = written(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges"
    )
    held = labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels"
    )
    while True:
        around = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
        )
        nearer = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")
        )
        to = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = written(
            nearer.join(to, "comp", "left").select(
                "node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")
            ),
            "labels",
        )
        discard(held)
        held, labels = step, step.select("node", "comp")
        if step.where("was <> comp").isEmpty():
            discard(both)
            return labels
