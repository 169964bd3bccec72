"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete.workspace import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest one among them and the node."""
    smallest = neighbours.groupBy("a").agg(F.min("b").alias("__b")).select(
        F.col("a").alias("__a"), F.least("a", "__b").alias("m")
    )
    met = neighbours.join(smallest, F.col("a") == F.col("__a"))
    if larger_only:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = smallest.where("__a != m").select(F.col("__a").alias("a"), F.col("m").alias("b"))
    return met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) that is not the smallest of its component.

    Large and small stars alternate until nothing changes: each round is two aggregations
    with map-side combining and two joins, written to the shared folder, and the number of
    rounds grows with the logarithm of the longest path. No group is gathered anywhere.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges.distinct())
    before = _state(edges)
    while before[0]:
        large = _star(_both_ways(edges), larger_only=True).distinct()
        # In (a, b) the second is the smaller: a small star looks at smaller neighbours only.
        small = _star(large, larger_only=False).where("a != b").distinct()
        edges = materialise(small)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
