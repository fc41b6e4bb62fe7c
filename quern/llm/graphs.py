"""Connected components by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, saved


def flattened(parents: DataFrame) -> DataFrame:
    """(node, parent) of a forest with parents below their children: each node with its root. Pointers double each time."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")
        )
        step = saved(step, "pointers")
        dropped(parents)
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Each round hangs every node below its smallest neighbour, flattens that forest, and goes on with the edges between
    different roots; the number of roots at least halves a round. All sums are minima, which combine before they are
    shuffled, so that a node with very many edges is no hot key.
    """
    edges = saved(edges.select("a", "b").filter("a <> b"), "edges")
    found = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parents = saved(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")),
            "parents",
        )
        roots = flattened(parents)
        if found is None:
            found = saved(roots.select("node", F.col("parent").alias("component")), "components")
        else:
            moved, former = roots.select(F.col("node").alias("component"), "parent"), found
            found = found.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            found = saved(found, "components")
            dropped(former)
        a, b = (roots.select(F.col("node").alias(x), F.col("parent").alias(f"{x}_root")) for x in "ab")
        left = edges.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        former, edges = edges, saved(left.filter("a <> b").distinct(), "edges")
        for done in (former, roots):
            dropped(done)
        if edges.isEmpty():
            dropped(edges)
            return found
