"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``(v, root)`` for each vertex of the edges ``(a, b)``; root is the component's least vertex.

    Alternates large-star and small-star contraction: each step hangs a
    vertex's neighbours on the least of them, keeps the number of edges from
    growing and ends after a logarithmic number of steps in stars. All state
    is in tables; only a row count and a checksum reach the driver. The least
    neighbours are written before they are joined, so that a hub's rows can be
    split by adaptive execution.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: every larger neighbour goes to the least of the neighbourhood
        least = written(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")), "least")
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        large = both.filter(F.col("w") > F.col("v")).join(least, "v", "left").select(F.col("w").alias("a"), F.coalesce("m", "v").alias("b")).distinct()
        large = written(large, "large")
        # small star: every smaller neighbour goes to the least of them, and so does the vertex
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components have not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
