"""Exact percentiles of groups of any size: brackets round the rank are narrowed by counts until few values are left.

Each round takes STEPS approximate percentiles of a bracket, whose state is bounded by ACCURACY, narrows to those round the
rank, and counts what lies below and inside; a bracket of n values goes on with about 3 n / STEPS. Brackets of at most FEW values, or of one
value alone, are settled by sorting what is inside. Only counts travel until then, so no state grows with a group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.sources.store import stored

STEPS, ACCURACY, FEW = 250, 4000, 1000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def exact_percentile(rows: DataFrame, keys: list[str], value: str, part: float, out: str = "cut") -> DataFrame:
    """keys, out: the percentile of each group, between its two nearest values if it falls between them. Null and NaN values
    don't count; a group without others has no row; null keys are a group."""
    names = [f"__k{i}" for i in range(len(keys))]
    values = stored(rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"), "values")
    sizes = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    place = (F.col("n") - 1) * F.lit(part)
    ranks = sizes.select(*names, "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), place.alias("place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    open_, done = stored(ranks, "ranks"), []
    while True:
        few = (F.col("inside") <= FEW) | (F.col("low") == F.col("high"))
        done.append(open_.where(few))
        open_ = open_.where(~few)
        if not open_.limit(1).count():
            break
        b = open_.select(*names, "low", "high", "below", "inside", "place", "rank")
        inside = b.join(values, _same(b, values, names) & values["v"].between(b["low"], b["high"])).select(*[b[c] for c in b.columns], values["v"])
        share = (F.col("rank") - F.col("below")) / F.col("inside")
        quantiles = F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
        found = inside.groupBy(*names, "low", "high", "below", "inside", "place", "rank").agg(quantiles.alias("q"))
        at = F.floor(share * STEPS).cast("int")
        found = found.select(*names, "low", "high", "below", "inside", "place", "rank", F.get("q", F.greatest(at - 1, F.lit(0))).alias("lo"), F.get("q", F.least(at + 2, F.lit(STEPS))).alias("hi"))
        found = stored(found.withColumn("lo", F.when(at <= 1, F.col("low")).otherwise(F.col("lo"))).withColumn("hi", F.when(at + 2 >= STEPS, F.col("high")).otherwise(F.col("hi"))), "brackets")
        counted = found.join(values, _same(found, values, names) & values["v"].between(found["low"], found["high"])).groupBy(*[found[c] for c in found.columns])
        v, middle = values["v"], F.col("low") / 2 + F.col("high") / 2
        counted = counted.agg(
            F.count_if(v < F.col("lo")).alias("less"), F.count_if(v.between(F.col("lo"), F.col("hi"))).alias("now"),
            F.count_if(v <= middle).alias("half"), F.max(F.when(v <= middle, v)).alias("under"), F.min(F.when(v > middle, v)).alias("over"),
        )
        left = F.col("below") + F.col("less")
        held = (F.col("rank") >= left) & (F.col("rank") < left + F.col("now")) & (F.col("now") < F.col("inside"))
        # Where the approximation narrows nothing, or missed the rank, the bracket's middle parts it; low and high lie on
        # either side of that, so each round leaves fewer values.
        lower = F.col("rank") < F.col("below") + F.col("half")
        pick = lambda a, b, c: F.when(held, a).when(lower, b).otherwise(c)
        open_ = stored(
            counted.select(
                *names, pick(F.col("lo"), F.col("low"), F.col("over")).alias("low"), pick(F.col("hi"), F.col("under"), F.col("high")).alias("high"),
                pick(left, F.col("below"), F.col("below") + F.col("half")).alias("below"), pick(F.col("now"), F.col("half"), F.col("inside") - F.col("half")).alias("inside"), "place", "rank",
            ),
            "ranks",
        )
    settled = stored(reduce(DataFrame.union, done), "settled")
    one = settled.where("low = high").select(*names, "place", "rank", F.col("low").alias("x"))
    some = settled.where("low < high")
    inner = some.join(values, _same(some, values, names) & values["v"].between(some["low"], some["high"])).groupBy(*[some[c] for c in (*names, "place", "rank", "below")])
    listed = inner.agg(F.sort_array(F.collect_list(values["v"])).alias("all")).select(*names, "place", "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("x"))
    both = one.unionByName(listed).groupBy(*names, "place").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    cut = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    return both.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], cut.alias(out))
