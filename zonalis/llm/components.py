"""Connected components of a link table, by alternating star contractions.

A large star links every larger neighbour of a node to the smallest node of its neighbourhood, a
small star every smaller neighbour (and the node) to the smallest. The links end as stars around the
smallest node of each component after about log(n) rounds. Each round is two shuffles on narrow
rows; minima are pre-aggregated before a shuffle and AQE splits the hot centre of a large star in
the joins. Rounds are cut by written tables, so a lost executor never restarts from the beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.common import stored

ROUNDS = 60


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node reachable.

    Links with a null end and self-links say nothing; repeated links count once.
    """
    hi, lo = F.greatest(left, right), F.least(left, right)
    edges = stored(links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
                   .select(hi.alias("hi"), lo.alias("lo")).distinct(), "links")
    for _ in range(ROUNDS):
        if _stars(edges):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        edges = stored(_small_star(_large_star(edges)), "links")
    raise RuntimeError(f"no stars after {ROUNDS} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and no centre has any."""
    ends = edges.select("hi", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    seen = ends.groupBy("hi").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()
