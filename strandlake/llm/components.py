"""Connected components of an edge table, by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest of its
neighbourhood, a small star every smaller one; alternating them ends in stars
around each component's smallest node after about log2 of its diameter rounds.
Each half round is two shuffles: the smallest neighbour of each node (summed up
before the shuffle) is written to the shared folder, so that the join that
follows broadcasts it while it is small and else sorts and merges, splitting
nodes with many neighbours.  Every half round's table is written too, which
ends the lineage; the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared


def _star(shared: Shared, edges: DataFrame, name: str, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = shared.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), f"{name}-low")
    joined = both.join(low, "a")
    if large:
        linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        linked = joined.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    result = shared.write(linked.where(F.col("a") != F.col("b")).distinct(), name)
    shared.drop(f"{name}-low")
    return result


def connected_components(shared: Shared, edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b: long) -> node, component (its smallest node), for nodes that have edges.

    Repeated edges and edges in both directions are allowed; an edge from a node
    to itself counts for nothing.
    """
    current = shared.write(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), f"{name}-0")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, turn = digest(current), 0
    while before[0]:
        turn += 1
        half = _star(shared, current, f"{name}-{turn}l", True)
        after = _star(shared, half, f"{name}-{turn}", False)
        shared.drop(f"{name}-{turn}l")
        shared.drop(f"{name}-{turn - 1}")
        now, current = digest(after), after
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class UnionFind:
    """Over the few items of one task's cell; roots are the smallest items."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.parent if self.root(x) != x]
