"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import join_sized, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (smallest reachable node) of all nodes of ``edges(a, b)``.

    Each round takes the smallest label among the neighbours and then the
    label of that label; every round is a written table, so an executor lost
    late does not repeat the earlier ones. Small label tables are broadcast; with
    larger ones Spark may split hubs.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("comp")
    ))
    while True:
        of_b = labels.select(F.col("node").alias("b"), "comp")
        near = join_sized(both, of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = join_sized(near, labels, "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = stored(join_sized(lower, jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")))
        changed = not new.where("comp <> old").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels
