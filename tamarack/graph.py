"""Connected components by contraction, all state in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def _flat(parent: DataFrame) -> tuple[DataFrame, int]:
    """(node, p) whose p are roots: every pointer doubles its reach in each step, so a chain of n takes log2(n) steps."""
    steps = 0
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        step = materialize(parent.select("node", "p").join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "cc-parent")
        steps += 1
        if step.where("moved").isEmpty():
            return step.select("node", "p"), steps
        parent = step


def connected_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component = its smallest node.

    A round points every node at its smallest neighbour where that is smaller than itself, flattens the pointers by
    doubling, and contracts: what is left are the edges between different roots. A root that outlives two rounds has
    taken in another one: either a neighbour points at it, or that neighbour's root is smaller and the root points there
    next. So the roots at least halve every two rounds, whatever the order of the ids. Hot nodes are safe: the steps are
    combined minima and joins on nodes, never lists. `rounds`, if given, receives the pointer steps of each round.
    Null ends and self loops: a self loop keeps its node as a component of one; null ends are dropped.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    label = materialize(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("root", F.col("node")), "cc-root")
    live = e.where("a != b")
    while not live.isEmpty():
        # an edge's smaller end is what the larger one may point at
        parent = materialize(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("p")), "cc-parent")
        parent, steps = _flat(parent)
        if rounds is not None:
            rounds.append(steps)
        root = lambda c: parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))
        label = materialize(label.join(root("root"), "root", "left").select("node", F.coalesce("proot", "root").alias("root")), "cc-root")
        ends = live.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        live = materialize(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    return label.withColumnRenamed("root", "component")
