"""Connected components by label propagation with pointer jumping; all state is in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm._common import discard, materialize


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (and ``old``, what was there before) for each node of ``links(a, b)``, the component being its smallest node.

    In each round a node takes the smallest label among its neighbours' and its own, and then that label's own label,
    so a chain halves in each round. Null ends and links of a node to itself are left out; an empty table gives no rows.
    """
    ends = links.where("a <> b").select("a", "b")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), f"{name}-links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.select("node", "component").join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = lower.join(roots, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component"))
        moved = materialize(moved, f"{name}-labels")
        discard(labels)
        labels = moved
        if not moved.where("component <> old").limit(1).count():
            discard(both)
            return labels
