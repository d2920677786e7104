"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, discard

#: Label propagation with pointer jumping needs about log2(diameter) rounds; more than so many are an error.
MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Every round takes the smallest label among the neighbours and then follows the label's own label, so a
    chain of n nodes needs about log2(n) rounds. All steps are joins and partial aggregates; nothing but the
    number of changed labels reaches the driver. Each round's tables are deleted once the next ones are written. Nodes without an edge do not appear; no edges give no rows.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    table = labels
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        moved = checkpoint(step.join(jump, "label").select("node", "old", F.col("jumped").alias("label")))
        changed = moved.where("old <> label").limit(1).count()
        discard(table)
        table, labels = moved, moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still move after {MAX_ROUNDS} rounds")
