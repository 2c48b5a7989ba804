"""Connected components by alternating large-star and small-star rounds, with aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges point from the larger to the smaller end
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node points to one other at most, and none that is pointed to points on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    loose = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return loose.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (any order, loops allowed). Returns node, root: the least node that is reachable, for every node with
    an edge to another. Rounds go on until every component is a star round its least node, which each round comes nearer
    to; both ends of a hot node are joined by splittable joins, and each round's table is written to shared storage."""
    current = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = common.settled(current, "edges")
    while not _is_star_forest(current):
        current = common.settled(_small_star(_large_star(current)), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
