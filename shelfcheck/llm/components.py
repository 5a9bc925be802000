"""Connected components of a graph given as links, by alternating star contractions.

Large-star hangs every larger neighbour of a node on the node's smallest neighbour, small-star every smaller one;
both keep the graph's connectivity, and a few rounds leave one star per component. Minima are taken before the
shuffle, and the joins back are plain equi-joins, whose hot keys adaptive execution splits. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another: root is the smallest node of its component.

    `links` holds pairs of comparable values; null ends and links to itself are left out, repeats change nothing.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    now = written(pairs.filter("x and y and u <> v").select("u", "v").distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        now, before = written(_small_star(_large_star(now)), "links"), state
        state = _state(now)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
