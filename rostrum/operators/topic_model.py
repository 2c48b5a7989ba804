"""A topic model over texts: TF-IDF, k-means, topic words, names and representative documents."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.text import tokens
from rostrum.operators.facets import ranked
from rostrum.operators.topics import class_tf_idf
from rostrum.sources.store import stored


def fit(docs: DataFrame, text: str, k: int = 250, features: int = 1 << 12, seed: int = 42) -> PipelineModel:
    """A saved model transforms new texts with `transform`."""
    return fit_tokens(stored(counted(tokenized(docs, text), features).select("tf"), "tokens"), k, features, seed)


def fit_tokens(words: DataFrame, k: int = 250, features: int = 1 << 12, seed: int = 42) -> PipelineModel:
    """The model of rows with `tokens`, or those of `counted`, which are read several times: a stored table saves taking texts
    apart and hashing tokens each time."""
    rows = words if "tf" in words.columns else stored(counted(words, features).select("tf"), "counts")
    weights = IDF(inputCol="tf", outputCol="tfidf").fit(rows)
    unit = Normalizer(inputCol="tfidf", outputCol="features")
    centres = KMeans(k=k, seed=seed, maxIter=10, featuresCol="features", predictionCol="topic_id").fit(unit.transform(weights.transform(rows)).select("features"))
    return PipelineModel([_hashing(features), weights, unit, centres])


def _hashing(features: int) -> HashingTF:
    return HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features)


def counted(words: DataFrame, features: int = 1 << 12) -> DataFrame:
    """Adds tf, the hashed counts of `tokens`, to be stored with them."""
    return _hashing(features).transform(words)


def tokenized(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("tokens", F.filter(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.length(t) > 2))


def transform(model: PipelineModel, docs: DataFrame, text: str, min_size: int = 3) -> DataFrame:
    """Adds topic_id; topics under min_size become -1."""
    return assigned(model, tokenized(docs, text), min_size)


def assigned(model: PipelineModel, words: DataFrame, min_size: int = 3, kept: list[str] | None = None) -> DataFrame:
    """`transform` of rows with `tokens`, or those of `counted` with the model's number of features. They are assigned once and
    stored, with the columns `kept` or all; sizes, a row for each topic, are sent along."""
    found = PipelineModel(model.stages[1:] if "tf" in words.columns else model.stages).transform(words).drop("tf", "tfidf")
    rows = stored(found.select(*kept, "topic_id") if kept else found, "assigned")
    sizes = rows.groupBy("topic_id").agg(F.count("*").alias("__n"))
    return rows.join(F.broadcast(sizes), "topic_id").withColumn("topic_id", F.when(F.col("__n") >= min_size, F.col("topic_id")).otherwise(-1)).drop("__n")


def topic_words(rows: DataFrame, n: int = 10) -> DataFrame:
    """topic_id, words, name: the n words that set a topic apart; the name is its id and first three."""
    scored = class_tf_idf(rows.select("topic_id", F.explode("tokens").alias("token")), "topic_id")
    order = W.partitionBy("topic_id").orderBy(F.round("score", 12).desc(), "token")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    words = top.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("r", "token"))).alias("x")).select("topic_id", F.col("x.token").alias("words"))
    return words.withColumn("name", F.array_join(F.concat(F.array(F.col("topic_id").cast("string")), F.slice("words", 1, 3)), "_"))


def topics_of(docs: DataFrame, key: str, text: str, k: int = 250) -> DataFrame:
    """key, topic_id, name."""
    words = stored(counted(tokenized(docs.select(key, text), text).select(key, "tokens")), "tokens")
    rows = assigned(fit_tokens(words, k), words, kept=[key, "tokens"])
    return rows.select(key, "topic_id").join(F.broadcast(topic_words(rows).select("topic_id", "name")), "topic_id", "left")


def representatives(rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """topic_id, rank, key, distance: the n documents of each topic nearest to its mean feature vector, ties by key; rows
    are those of `transform`. Outliers have none."""
    real = rows.where("topic_id >= 0")
    means = real.groupBy("topic_id").agg(Summarizer.mean(F.col("features")).alias("m"))
    pairs = real.select(key, "topic_id", vector_to_array("features").alias("x")).join(F.broadcast(means.select("topic_id", vector_to_array("m").alias("m"))), "topic_id")
    square = F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return ranked(pairs.select("topic_id", key, F.round(F.sqrt(square), 9).alias("distance")), ["topic_id"], F.col("distance"), F.col(key)).where(F.col("rank") <= n)


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """Writes a model to a shared folder and loads it again."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
