"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them. Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v")


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is the smallest node reachable.

    Loops, repeats and direction do not matter. A hub's edges are never gathered: minima are combined
    before the shuffle, and the join that hands them back is one whose large side Spark can split.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    mark = None
    for _ in range(most_rounds):
        now = cut_lineage(small_star(large_star(now)).distinct())
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over 0 .. n - 1, by union-find; at most n - 1 edges."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[y] = x
            kept.append((a, b))
    return kept
