"""Connected components of a graph given as edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.session import pin


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the smallest node that can be reached.

    Every round each node takes the smallest label among its neighbours and then the label of
    its label, so paths shorten fast. Labels are stored after each round, which cuts the
    lineage; minima are combined before the shuffle, so a node with very many edges is no
    load. Nodes without edges do not appear; no edges give an empty table. With ``most_rounds``
    it may stop early: nodes with equal labels are then connected, but not the other way round.
    """
    both = pin(
        edges.where("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    turn = 0
    while most_rounds is None or turn < most_rounds:
        turn += 1
        heard = (
            both.join(labels, F.col("a") == F.col("node"))
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "heard").alias("component")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("component").alias("grand"))
        after = pin(
            lower.join(parents, F.col("component") == F.col("parent")).select(
                "node", "before", F.least("component", "grand").alias("component")
            )
        )
        labels = after.select("node", "component")
        if after.where(F.col("before") != F.col("component")).isEmpty():
            break
    return labels
