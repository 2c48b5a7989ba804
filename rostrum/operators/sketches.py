"""A cube of sketches: distinct counts and most frequent values of any selection of its cells, without the rows.

A cell (term and year, or also province) holds its number of speeches, HyperLogLog sketches of its distinct values and lists
of its most frequent ones. Cells merge by union, so a filter on cells costs as much as it has cells, however many speeches
they stand for, and new speeches are added by merging their own cells. Distinct counts err by about 0.8 % (PRECISION 14; one
standard error), top counts are exact while a cell has no more than TRACKED values of a column. Nulls count as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.sources.schema import analysed_topic

PRECISION, TRACKED = 14, 1000
DISTINCT = ("session_id", "speech_giver", "topic_id")
TOP = ("political_party_at_time", "topic_id", "province")


def cube(speeches: DataFrame, *keys: str) -> DataFrame:
    """A row a cell: keys, speeches, first_term ... last_year, a sketch of each DISTINCT and a list of each TOP column."""
    rows = speeches.withColumn("__topic", F.when(analysed_topic(F.col("topic_id"), ()), F.col("topic_id")))
    own = lambda c: "__topic" if c == "topic_id" else c
    distinct = [F.hll_sketch_agg(own(c), PRECISION).alias(f"{c}_distinct") for c in DISTINCT]
    top = [F.expr(f"approx_top_k_accumulate({c}, {TRACKED}) FILTER (WHERE {c} IS NOT NULL)").alias(f"{c}_top") for c in TOP if c not in keys]
    return rows.groupBy(*keys).agg(F.count("*").alias("speeches"), F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), *distinct, *top)


def merged(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells of fewer keys (none: one row), or of several cubes as one."""
    distinct = [F.hll_union_agg(f"{c}_distinct").alias(f"{c}_distinct") for c in DISTINCT]
    top = [F.expr(f"approx_top_k_combine({c}_top, {TRACKED})").alias(f"{c}_top") for c in TOP if f"{c}_top" in cells.columns]
    edge = [f(c).alias(c) for f, c in ((F.min, "first_term"), (F.max, "last_term"), (F.min, "first_year"), (F.max, "last_year"))]
    return cells.groupBy(*keys).agg(F.coalesce(F.sum("speeches"), F.lit(0)).alias("speeches"), *edge, *distinct, *top)


def estimate(column: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(f"{column}_distinct"), F.lit(0))


def index_stats(cells: DataFrame, recent: int = 17) -> DataFrame:
    """One row of totals, distinct counts (estimated) and ranges of the given cells, which have a term."""
    whole = merged(cells)
    late = merged(cells.where(F.col("term") >= recent)).select(estimate("speech_giver").alias("recent_members"))
    names = (("session_id", "sessions"), ("speech_giver", "members"), ("topic_id", "topics"))
    return whole.select("speeches", *[estimate(c).alias(n) for c, n in names], "first_term", "last_term", "first_year", "last_year").crossJoin(F.broadcast(late))


def top_values(cells: DataFrame, column: str, n: int) -> DataFrame:
    """value, cnt: the n most frequent values of the given cells."""
    found = merged(cells).select(F.explode(F.expr(f"approx_top_k_estimate({column}_top, {n})")).alias("x"))
    return found.select(F.col("x.item").alias("value"), F.col("x.count").alias("cnt"))


def busiest(cells: DataFrame, by: str = "province") -> DataFrame:
    """by, speeches, members, ratio of speeches to distinct members for cells keyed by it, greatest first."""
    found = merged(cells, by).select(by, "speeches", estimate("speech_giver").alias("members"))
    return found.withColumn("ratio", F.col("speeches") / F.col("members")).orderBy(F.col("ratio").desc(), by)
