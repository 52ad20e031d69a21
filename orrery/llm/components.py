"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise


def _smallest(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_smallest(both), "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_smallest(down), "u")
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node on an edge (u, v); root is the smallest node of its component.

    Edges stay distributed; the driver sees a count and a checksum a round. The number of rounds grows with the
    logarithm of the longest chain. A node with very many edges is a hot join key, which AQE splits, and is
    pre-aggregated in the minimum. Each round is written to the shared folder, so a lost executor costs one round.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = _digest(edges)
    while digest[0]:
        edges = materialise(_small_star(_large_star(edges)))
        last, digest = digest, _digest(edges)
        if last == digest:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
