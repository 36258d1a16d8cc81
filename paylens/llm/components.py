"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(edges: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """node and label, the smallest node of its component, for every node of edges(a, b).

    Every round gives each node the least label among its own and its neighbours' and then that label's own
    label, so labels travel twice as far each time. Rounds end when no label changes. Each is written to the
    shared folder; the only value that reaches the driver is the number of changes.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"))
    labels = scratch.table(labels, "labels")
    for _ in range(rounds):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        target = nearer.select(F.col("node").alias("target"), F.col("label").alias("further"))
        moved = nearer.join(target, F.col("label") == F.col("target")).select("node", "was", F.least("label", "further").alias("label"))
        moved = scratch.table(moved, "labels")
        changed = moved.filter("label <> was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
