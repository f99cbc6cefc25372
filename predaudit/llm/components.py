"""Connected components by alternating large-star and small-star steps, each an aggregation and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predaudit.functions.lineage import store


def _around(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: ``(node, other, up)``, where ``up`` marks the way to the smaller end."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), F.lit(1).alias("up")).union(
        edges.select(F.col("b"), F.col("a"), F.lit(0))
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes that are not the smallest of their component. ``edges`` has longs a and b.

    A large step ties all larger neighbours of a node to the smallest node within one step, a small step the others; when every node has
    either one smaller neighbour and no larger one or only larger ones, each edge leads to the smallest node of its component.

    Every step is written out, so a lost executor costs one step. A hub's edges meet no window and no collected list: the
    minimum is combined before the shuffle, and the join with the written minima is one the runtime can split.
    """
    current = store(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc-edges"
    )
    while True:
        nodes = store(
            _around(current).groupBy("node").agg(F.min("other").alias("least"), F.count_if(F.col("up") == 1).alias("up"), F.min("up").alias("leaf"))
            .select("node", F.least("node", "least").alias("least"), ((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("leaf") == 0))).alias("open")),
            "cc-nodes",
        )
        if nodes.where("open").isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        large = store(
            _around(current).join(nodes, "node").where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")),
            "cc-large",
        )
        least = store(large.groupBy("a").agg(F.min("b").alias("least")), "cc-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
        current = store(small.where("a != b").distinct(), "cc-small")
