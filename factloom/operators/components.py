"""Connected components by alternating large and small stars: no edge leaves the executors, rounds grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import written


#: Edges from which on a node may have too many of them for one task.
MANY = 5_000_000


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """Link neighbours to the least node of a neighbourhood: those above the node (large), or those below it and itself (small)."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if many:
        # Written, the join reads nothing but its two sides, and Spark can split a node that very many edges share.
        least = written(least)
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node of its component.

    Each round is written to the shared folder. Nodes without edges are not listed; self-loops and repeated edges do no harm. Raises
    where labels still change after `rounds` rounds, rather than return some of them.
    """
    now = written(edges.filter(F.col("u") != F.col("v")).distinct())
    seen, many = None, now.count() > MANY
    for _ in range(rounds):
        now = written(_star(_star(now, True, many), False, many))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
