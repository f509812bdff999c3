"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import stage

MOST_ROUNDS = 50


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    siblings = down.join(least, "a").filter(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return siblings.union(least.select("a", F.col("_m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` of one orderable type); the root is the component's smallest node.

    Self-loops and repeated edges add nothing, edges with a null end are dropped, and no edges give no rows.
    """
    current = stage(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "components")
    before = None
    for _ in range(MOST_ROUNDS):
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        current = stage(_small_star(_large_star(current)).distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
