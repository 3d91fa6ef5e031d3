"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Each step keeps, per node, the smallest neighbour (a partial aggregate) and re-hangs the others below
it (a join that adaptive execution splits at hubs). Edges never leave the cluster; the driver sees a
count and a checksum per round, and the edges of a round are discarded with the next. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both)
    joined = both.join(least, F.col("u") == F.col("node")).where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), F.col("u") == F.col("node"))
    ends = F.when(F.col("v") == F.col("m"), F.array("u")).otherwise(F.array("u", "v"))
    return joined.select(F.explode(ends).alias("u"), F.col("m").alias("v")).distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node that is in a pair (a, b) with a <> b."""
    edges = pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(edges.distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        old, edges = edges, staged(_small_star(_large_star(edges)), "stars")
        discard(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
