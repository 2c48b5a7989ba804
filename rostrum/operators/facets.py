"""Counts, facets and statistics over speeches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.sources.schema import analysed_topic


def ranked(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return ranked(df, keys, *order, name="__rank").where("__rank = 1").drop("__rank")


def modal(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None) -> DataFrame:
    """The most frequent non-null value of each key, ties by value. weight: a column that says how often a row counts."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(out)).agg(n.alias("__n"))
    return best(counts, keys, F.col("__n").desc(), F.col(out)).drop("__n")


def topic_statistics(speeches: DataFrame) -> DataFrame:
    """topic_id, topic_label (the most frequent), speech_count, for topics that are present and no sentinel."""
    counts = labelled_counts(speeches.where(analysed_topic(F.col("topic_id"), ())), ["topic_id"], "speech_count")
    return counts.withColumn("topic_label", F.coalesce("topic_label", F.concat(F.lit("Topic "), "topic_id")))


def labelled_counts(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """keys, count, topic_label: rows of each key and its most frequent label, ties by label. Rows are counted by key and
    label once, then rolled up."""
    counts = rows.groupBy(*keys, "topic_label").agg(F.count("*").alias("__n"))
    often = F.when(F.col("topic_label").isNotNull(), F.struct(-F.col("__n"), "topic_label"))
    return counts.groupBy(*keys).agg(F.sum("__n").alias(count), F.min_by("topic_label", often).alias("topic_label"))


def shares(counts: DataFrame, keys: list[str], count: str = "cnt", out: str = "pct") -> DataFrame:
    """Percent of the key's total, taken before any top-n, to one decimal."""
    total = F.sum(count).over(W.partitionBy(*keys))
    return counts.withColumn(out, F.round(F.col(count) * 100.0 / total, 1))


def top_topics(speeches: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """keys, topic_id, topic_label, cnt, pct: the top_n topics of each key; percents of all its counted speeches."""
    rows = speeches.where(analysed_topic(F.col("topic_id")))
    counts = shares(labelled_counts(rows, [*keys, "topic_id"], "cnt"), keys)
    return ranked(counts, keys, F.col("cnt").desc(), F.col("topic_id")).where(F.col("rank") <= top_n).drop("rank")


def activity(speeches: DataFrame, calendar: DataFrame) -> DataFrame:
    """speech_giver, calendar_year, speeches, term, year: counts by the year in which a (term, year) starts; the first
    such pair stands for the year. Pairs that the calendar lacks are dropped."""
    counts = speeches.groupBy("speech_giver", "term", "year").agg(F.count("*").alias("n"))
    dated = counts.join(F.broadcast(calendar), ["term", "year"])
    first = F.min(F.struct("term", "year"))
    grouped = dated.groupBy("speech_giver", F.col("year_from").alias("calendar_year")).agg(F.sum("n").alias("speeches"), first.alias("first"))
    return grouped.select("speech_giver", "calendar_year", "speeches", "first.term", "first.year")


#: Facet columns, how many values of each are shown, and whether they are ordered by value (descending) or count.
FACETS = {"term": (50, "value"), "year": (10, "value"), "political_party_at_time": (50, "count"), "topic_id": (200, "count"), "province": (100, "count")}


def facets(speeches: DataFrame, limits: dict = FACETS) -> DataFrame:
    """facet, value, cnt, rank: all facets in one pass over the speeches."""
    columns = list(limits)
    sets = speeches.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), (F.col(c).cast("long") if limits[c][1] == "value" else F.lit(None).cast("long")).alias("place")) for c in columns])).alias("f")).select("f.*")
    counts = sets.where("value is not null").groupBy("facet", "value", "place").agg(F.count("*").alias("cnt"))
    order = ranked(counts, ["facet"], F.col("place").desc_nulls_last(), F.col("cnt").desc(), F.col("value"))
    most = F.element_at(F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(limits[c][0]))]), F.col("facet"))
    return order.where(F.col("rank") <= most).drop("place")


def index_stats(speeches: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals, distinct counts and ranges."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return speeches.agg(
        F.count("*").alias("speeches"), distinct("session_id").alias("sessions"), distinct("speech_giver").alias("members"), distinct(F.when(analysed_topic(F.col("topic_id"), ()), F.col("topic_id"))).alias("topics"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), distinct(F.when(F.col("term") >= 17, F.col("speech_giver"))).alias("recent_members"),
    )


def top_entities(nested: DataFrame, entity_group: str | None = None, mode: str = "document", limit: int = 50) -> DataFrame:
    """entity, mentions, entity_group (the most frequent). With a type, mode `document` counts all entities of speeches
    that hold the type, mode `entity` only entities of it."""
    rows = nested
    if entity_group and mode == "document":
        rows = rows.where(F.exists("ner_entities", lambda e: e["entity_group"] == entity_group))
    flat = rows.select(F.explode("ner_entities").alias("e")).select("e.entity", "e.entity_group")
    if entity_group and mode == "entity":
        flat = flat.where(F.col("entity_group") == entity_group)
    counts = flat.groupBy("entity").agg(F.count("*").alias("mentions"))
    top = counts.orderBy(F.col("mentions").desc(), "entity").limit(limit)
    # Types are counted for the few top entities alone.
    named = flat.join(F.broadcast(top.select("entity")), "entity", "left_semi")
    return top.join(modal(named, ["entity"], "entity_group", "entity_group"), "entity")


def summary(speeches: DataFrame, drop_outliers: bool = True) -> DataFrame:
    """speech_giver, topic_id, topic_label, speech_count, terms, years; rows that lack a key drop out."""
    rows = speeches.where("speech_giver is not null and topic_id is not null and topic_label is not null")
    if drop_outliers:
        rows = rows.where("topic_id <> -1")
    listed = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("speech_giver", "topic_id", "topic_label").agg(F.count("*").alias("speech_count"), listed("term").alias("terms"), listed("year").alias("years"))


def histogram(speeches: DataFrame) -> DataFrame:
    """calendar_year, speeches; years without speeches count 0."""
    counts = speeches.groupBy(F.year("session_date").alias("calendar_year")).agg(F.count("*").alias("n"))
    span = counts.agg(F.explode(F.sequence(F.min("calendar_year"), F.max("calendar_year"))).alias("calendar_year"))
    return span.join(counts, "calendar_year", "left").select("calendar_year", F.coalesce("n", F.lit(0)).alias("speeches"))
