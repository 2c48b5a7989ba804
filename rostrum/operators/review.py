"""The year in review: one row for each (term, year), all periods in one pass.

Every part works on cells, or on speeches, of which each is a cell of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.text import format_topic_name
from rostrum.operators.facets import best, modal
from rostrum.sources.schema import analysed_topic
from rostrum.sources.store import stored

PERIOD = ["term", "year"]
CELL = [*PERIOD, "topic_id", "speech_giver", "province", "topic_label"]
#: The speeches of a cell.
N = "__speeches"


def cells(speeches: DataFrame) -> DataFrame:
    """Speeches counted by all that the review asks for, so that they are read and shuffled once."""
    return stored(speeches.groupBy(*CELL).agg(F.count("*").alias(N)), "review-cells")


def _counted(speeches: DataFrame) -> DataFrame:
    return speeches if N in speeches.columns else speeches.withColumn(N, F.lit(1).cast("long"))


def _topics(speeches: DataFrame) -> DataFrame:
    return _counted(speeches).where(analysed_topic(F.col("topic_id")))


def most_talked(speeches: DataFrame) -> DataFrame:
    rows = _topics(speeches)
    top = best(rows.groupBy(*PERIOD, "topic_id").agg(F.sum(N).alias("talked_count")), PERIOD, F.col("talked_count").desc(), F.col("topic_id"))
    named = top.join(modal(rows, [*PERIOD, "topic_id"], "topic_label", "label", N), [*PERIOD, "topic_id"], "left")
    return named.select(*PERIOD, F.col("topic_id").alias("talked_topic"), format_topic_name(F.col("label")).alias("talked_name"), "talked_count")


def most_active(speeches: DataFrame) -> DataFrame:
    rows = _counted(speeches).where("speech_giver is not null")
    top = best(rows.groupBy(*PERIOD, "speech_giver").agg(F.sum(N).alias("active_count")), PERIOD, F.col("active_count").desc(), F.col("speech_giver"))
    home = modal(rows, [*PERIOD, "speech_giver"], "province", "active_province", N)
    joined = top.join(home, [*PERIOD, "speech_giver"], "left")
    return joined.select(*PERIOD, F.col("speech_giver").alias("active_member"), F.coalesce("active_province", F.lit("Unknown")).alias("active_province"), "active_count")


def busiest_province(speeches: DataFrame, candidates: int = 100) -> DataFrame:
    """Most speeches a member, among the provinces with the most speeches."""
    counts = _counted(speeches).where("province is not null").groupBy(*PERIOD, "province").agg(F.sum(N).alias("n"), F.count_distinct("speech_giver").alias("m"))
    order = W.partitionBy(*PERIOD).orderBy(F.col("n").desc(), "province")
    counts = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= candidates)
    top = best(counts.withColumn("x", F.col("n").cast("double") / F.col("m")), PERIOD, F.col("x").desc(), F.col("province"))
    return top.select(*PERIOD, F.col("province").alias("shining_province"), F.round("x", 1).alias("shining_ratio"))


def niche(speeches: DataFrame) -> DataFrame:
    rows = _topics(speeches)
    low = best(rows.groupBy(*PERIOD, "topic_id").agg(F.sum(N).alias("niche_count")), PERIOD, F.col("niche_count"), F.col("topic_id"))
    who = modal(rows, [*PERIOD, "topic_id"], "speech_giver", "niche_member", N)
    return low.join(who, [*PERIOD, "topic_id"], "left").withColumnRenamed("topic_id", "niche_topic")


def most_diverse(speeches: DataFrame) -> DataFrame:
    counts = _topics(speeches).groupBy(*PERIOD, "topic_id").agg(F.count_distinct("speech_giver").alias("diverse_members"))
    top = best(counts, PERIOD, F.col("diverse_members").desc(), F.col("topic_id"))
    return top.select(*PERIOD, F.col("topic_id").alias("diverse_topic"), "diverse_members", F.least((F.col("diverse_members") * 0.3).cast("int"), F.lit(15)).alias("perspectives"))


def declining(speeches: DataFrame) -> DataFrame:
    """The topic that lost the most speeches against the period before; null for the first period."""
    rows = _topics(speeches)
    counts = rows.groupBy(*PERIOD, "topic_id").agg(F.sum(N).alias("n"))
    periods = rows.select(*PERIOD).distinct()
    # Periods are few, whatever the speeches are.
    order = W.partitionBy(F.lit(0)).orderBy("term", "year")
    periods = periods.withColumn("before_term", F.lag("term").over(order)).withColumn("before_year", F.lag("year").over(order))
    before = counts.select(F.col("term").alias("before_term"), F.col("year").alias("before_year"), "topic_id", F.col("n").alias("n_before"))
    pairs = F.broadcast(periods).join(before, ["before_term", "before_year"]).join(counts, [*PERIOD, "topic_id"], "left")
    drops = pairs.withColumn("drop", F.coalesce("n", F.lit(0)) - F.col("n_before"))
    return best(drops, PERIOD, F.col("drop"), F.col("topic_id")).select(*PERIOD, F.col("topic_id").alias("declining_topic"), F.col("drop").alias("declining_change"))


def annual_review(speeches: DataFrame) -> DataFrame:
    counted = cells(speeches)
    out = counted.select(*PERIOD).distinct()
    for part in (most_talked, most_active, busiest_province, niche, most_diverse, declining):
        out = out.join(part(counted), PERIOD, "left")
    return out
