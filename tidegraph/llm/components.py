"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for the nodes of ``edges(a, b)``; the component is its
    smallest node.

    Every node moves to its smallest neighbour (or stays, if it is smaller), and
    the edges follow; loops and repeats go. The smallest node of a component
    never moves, and what is left shrinks at least by half each time, so a few
    rounds are enough even for long chains. Each round is saved.
    """
    edges = scratch.save(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a") != F.col("b")).distinct()
    )
    moved: DataFrame | None = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        step = scratch.save(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("to"))
        )
        if moved is None:
            moved = step.select("node", F.col("to").alias("component"))
        else:
            then = step.select(F.col("node").alias("component"), "to")
            moved = scratch.save(
                moved.join(then, "component", "left")
                .select("node", F.coalesce("to", "component").alias("component"))
            )
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        other = step.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        edges = scratch.save(
            edges.join(ends, "a").join(other, "b")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .where(F.col("a") != F.col("b")).distinct()
        )
        if edges.isEmpty():
            return moved
