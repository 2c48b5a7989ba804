"""Numbers in an order, without gathering a group in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.sources.store import stored


def numbered(df: DataFrame, order: list[str | Column], groups: list[str] | None = None, out: str = "n") -> DataFrame:
    """Adds each row's place, from 0 on, in an order within its group (null is a group). Rows are dealt by ranges of the
    order; tasks number their own rows, and the few counts by group and range say where each range begins."""
    groups = groups or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *groups, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*groups, "__part").agg(F.count("*").alias("__rows"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).select(*[F.col(c).alias(f"__of_{c}") for c in [*groups, "__part"]], "__start")
    same = reduce(and_, [dealt[c].eqNullSafe(starts[f"__of_{c}"]) for c in [*groups, "__part"]])
    place = F.row_number().over(W.partitionBy(*groups, "__part").orderBy(*order)) - 1
    return dealt.join(starts, same).withColumn(out, place + F.col("__start")).select(*df.columns, out)
