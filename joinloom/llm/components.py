"""Connected components of an edge table by alternating large-star and small-star steps.

Edges never reach the driver.  Each step is one join of the edges with the smallest neighbour of each vertex; the
result is written to the shared folder, which cuts the lineage and survives lost executors, and the tables of the step
before are deleted.  Hubs are safe: the smallest neighbour is a partial aggregate, and adaptive execution splits what a
hub's join reads.  The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) that isn't its component's smallest; null ends are left out."""
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "cc")
    state = _state(edges)
    for _ in range(most_steps):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # a > b in every row
        large = written(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(edges, large)
        edges = small
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
