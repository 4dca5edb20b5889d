"""Connected components of a table of links, as DataFrame operations.

Alternating large-star and small-star steps (each vertex hands its larger, then its smaller neighbours
to the smallest one it knows) until nothing changes. A vertex with very many links is a skewed key of a
plain join, which adaptive execution splits; minima are combined before the shuffle. Every round is
written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.storage import drop_shared, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u != v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = moved.union(least.select("u", F.col("m").alias("v")))
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """``links``: u, v. Returns vertex, component (the smallest vertex reachable) for vertices that have links.

    Rounds needed grow with the logarithm of the longest path; ending without a fixed point is an error, never a result.
    """
    edges = written(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        step = written(_small(_large(edges)), "links")
        # a fixed point: every vertex has one edge, to a vertex that has none above it
        state = tuple(step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_shared(links.sparkSession, edges)
        edges = step
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
