"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either length is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def scaled(a: Column) -> Column:
    """To length 1; unchanged if zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Element-wise means. Each place is summed before the shuffle; a group's vectors never meet."""
    places = df.select(*keys, F.posexplode(vector).alias("i", "x"))
    means = places.groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out))
