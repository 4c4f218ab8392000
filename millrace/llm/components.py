"""Connected components of an edge table by repeated hooking and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch


def _short_cut(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow (node, parent) pointers, each smaller than its node, to the roots."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = scratch.cut(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            )
        )
        moved = step.filter("moved").limit(1).count()
        parents = step.select("node", "parent")
        if not moved:
            return parents


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) edges of long ids -> (node, component): the smallest id that can be reached.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the pointers to
    their roots and contracts. Nodes without an edge aren't listed; an empty table gives an empty one.
    The groups of hub nodes are minima, combined before the shuffle; no neighbour list is ever built.
    """
    edges = scratch.cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = _short_cut(scratch.cut(hooks), scratch)
        if labels is None:
            labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
        named = roots.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = scratch.cut(
            labels.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        at_a = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        at_b = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        left = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(
            F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")
        )
        edges = scratch.cut(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels
