"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.spread import with_least
from palimpsest.sources.scratch import remove_saved, saved


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels the nodes of an undirected graph.

    `edges` has two bigint columns (a, b); nulls and loops are ignored. Returns
    one row (node, component) for each node that has an edge; component is the
    smallest node reachable. An empty table gives an empty result.

    Each round points every node's neighbours at the smallest of them (large
    star, then small star), which takes O(log^2 n) rounds. Every round is
    written to the shared folder, so a lost executor costs one round at most; the
    round before it is removed once the next one stands. A node with very many
    neighbours is dealt out in parts, see `with_least`; no list of neighbours is
    collected.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = saved(edges, "cc")
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node move to the smallest of its closed neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            with_least(both, "a", "b", "m")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # Small star: neighbours below a node, and the node itself, move to the smallest.
        small = (
            with_least(large, "a", "b", "m")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        last, edges = edges, saved(small, "cc")
        remove_saved(last)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
