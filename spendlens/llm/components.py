"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node reachable.

    ``edges``: columns a and b, of one type, in any direction, repeated or not.
    Each round ties every node first to the smallest node near it, then the
    smaller neighbours of a node to each other (Kiveris and others, 2014).
    Edges never grow in number, a node with many neighbours is one row per
    task in the aggregation, and its edges are joined with a kept table, so a
    join of them can be split.
    """
    now = keep(_distinct(edges.filter("a <> b")), "edges")
    mark = None
    for _ in range(rounds):
        now = keep(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 2**40).alias("s")).first()
        if seen == mark:
            # Each node now has one edge, to its root.
            roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.union(now.select("a", "a").distinct())
        mark = seen
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node next to it (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b"), F.col("a"))
    )
    least = keep(
        both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least"
    )
    # Edges run from a (smaller) to b: b is the larger neighbour of a.
    return _distinct(
        edges.join(least.withColumnRenamed("u", "a"), "a").select(F.col("m").alias("a"), "b")
    ).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    edges = keep(edges, "large-star")
    least = keep(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    moved = edges.join(least, "b")
    return _distinct(
        moved.select(F.col("m").alias("a"), "b").union(
            moved.select(F.col("m"), F.col("a"))
        )
    ).filter("a <> b")
