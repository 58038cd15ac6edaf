"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.runtime import cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """``node, component``: of each node in an edge the smallest node it is connected with.

    Alternating large-star and small-star steps: each keeps the number of edges within the original one and the number
    of rounds logarithmic. The frames stay distributed and are cut each round. NULL ends are ignored; self-loops make
    their node a component; an empty table has no components. ``most`` rounds without an end raise an error.
    """
    both = edges.select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = both.select(F.col("a").alias("node")).union(both.select(F.col("b"))).distinct()
    e = both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, sign = cut(e), None
    last = e
    for _ in range(most):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (itself included).
        n = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        low = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = n.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        s = e.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u")
        e = s.select(F.col("m").alias("a"), F.col("v").alias("b")).union(s.select(F.col("m"), F.col("u"))).where("a <> b").distinct()
        e = cut(e)
        discard(last)
        last = e
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if tuple(r) == sign:
            break
        sign = tuple(r)
    else:
        raise RuntimeError("components did not settle")
    out = nodes.join(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "node", "left")
    return out.select("node", F.coalesce("component", "node").alias("component"))
