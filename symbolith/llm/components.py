"""Connected components of an undirected graph by alternating star contractions.

Edges stay in tables: each step joins every edge with the smallest neighbour of one end, so a vertex with very many
edges is a skewed join, which adaptive execution splits, never one group in one task. Each step's edges are written to
the shared folder, and go once the next ones are there. The steps end when they change nothing, after a number that grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """The next edges, written; the given ones are deleted. Large star: larger neighbours move to the smallest of the vertex and its neighbours. Small star: the smaller
    neighbours and the vertex do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        found = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    found = stash(found.filter("a <> b").distinct(), name)
    drop(edges, least)
    return found


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges; its sum is exact whatever the order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one ordered type. Per vertex that has an edge to another one: vertex, root (the smallest reachable)."""
    edges = stash(edges.filter("a <> b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = _star(_star(edges, True, "large"), False, "small")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.greatest("a", "b").alias("vertex"), F.least("a", "b").alias("root"))
    roots = stash(roots.unionByName(roots.select(F.col("root").alias("vertex"), "root")).distinct(), "roots")
    drop(edges)
    return roots
