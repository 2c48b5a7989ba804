"""Context windows and the movement of word senses over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.text import tokens
from rostrum.functions.vectors import cosine


def contexts(docs: DataFrame, key: str, content: str, word: str, window: int = 10) -> DataFrame:
    """key, pos, token, context: the words round each token that begins with the word."""
    listed = docs.select(key, tokens(F.col(content)).alias("words")).where(F.exists("words", lambda t: F.startswith(t, F.lit(word.lower()))))
    hits = listed.select(key, "words", F.posexplode("words").alias("pos", "token")).where(F.startswith(F.col("token"), F.lit(word.lower())))
    first = F.greatest(F.col("pos") + 1 - window, F.lit(1))
    return hits.select(key, "pos", "token", F.array_join(F.slice("words", first, F.col("pos") + 1 + window - first + 1), " ").alias("context"))


def drift(timeline: DataFrame, keys: list[str], order: list[str], vector: str, size: str, frozen: str | None = None) -> DataFrame:
    """x: distance from the first period's vector; y: from the one before (0 at first); z: share of the period's size.
    With `frozen`, that column stands for each period's vector, as where a sense's centre never moves."""
    by = W.partitionBy(*keys).orderBy(*order)
    v = F.col(frozen or vector)
    first = timeline.withColumn("__first", F.first(v).over(by)).withColumn("__before", F.lag(v).over(by))
    far = lambda a: 1 - cosine(v, F.col(a))
    total = F.sum(size).over(W.partitionBy(*order))
    y = F.when(F.col("__before").isNull(), 0.0).otherwise(far("__before"))
    return first.withColumn("x", far("__first")).withColumn("y", y).withColumn("z", F.col(size).cast("double") / total).drop("__first", "__before")


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows that begin where `starts` holds."""
    by = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by))


def merge_word_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity_group, word, score: pieces (pos, word, entity_group, score) that begin with ## join the word before
    if it has their type; scores fold as the mean of what is there and the next."""
    by = W.partitionBy(*keys).orderBy("pos")
    joins = F.startswith("word", F.lit("##")) & (F.col("entity_group") == F.col("__before"))
    marked = islands(pieces.withColumn("__before", F.lag("entity_group").over(by)), keys, "pos", ~joins)
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "entity_group", "score")))
    grouped = marked.groupBy(*keys, "island").agg(listed.alias("p"))
    word = F.array_join(F.transform("p", lambda s: F.when(F.startswith(s["word"], F.lit("##")), F.substring(s["word"], F.lit(3), F.length(s["word"]))).otherwise(s["word"])), "")
    score = F.aggregate(F.slice("p", F.lit(2), F.size("p")), F.col("p")[0]["score"], lambda acc, s: (acc + s["score"]) / 2)
    return grouped.select(*keys, F.col("p")[0]["pos"].alias("pos"), F.col("p")[0]["entity_group"].alias("entity_group"), word.alias("word"), score.alias("score"))
