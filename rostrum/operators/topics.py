"""Topics from vectors and keywords: centroids, matching, refinement, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.vectors import cosine, dot, mean_vectors, scaled
from rostrum.operators.order import numbered
from rostrum.sources.schema import analysed_topic
from rostrum.sources.store import stored

#: Most centroids (rows) that are broadcast for matching; beyond, they are matched in groups of this size.
GROUP = 4096


def centroids(vectors: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    """topic_id, centroid of topics that are present and no sentinel."""
    return mean_vectors(vectors.where(analysed_topic(F.col(topic), ())), [topic], vector)


def similarities(vectors: DataFrame, centers: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, topic_id, sim for every vector and centre: an explicit product with a stated, small side."""
    unit = vectors.select(key, scaled(F.col(vector)).alias("__v"))
    target = stored(centers.select("topic_id", scaled(F.col("centroid")).alias("__c")), "centres")
    n = target.count()
    if n <= GROUP:
        return unit.crossJoin(F.broadcast(target)).select(key, "topic_id", dot(F.col("__v"), F.col("__c")).alias("sim"))
    groups = -(-n // GROUP)
    parts = [unit.crossJoin(F.broadcast(target.where(F.pmod(F.xxhash64("topic_id"), F.lit(groups)) == g))) for g in range(groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "topic_id", dot(F.col("__v"), F.col("__c")).alias("sim"))


def nearest(vectors: DataFrame, centers: DataFrame, key: str, vector: str = "embedding", threshold: float = 0.7) -> DataFrame:
    """key, topic_id, sim: the most similar centre, ties to the lesser id; topic_id is null under the threshold. Centres
    that fit one row are looked through within each vector's row, so vectors don't travel."""
    centers = stored(centers, "centres")
    if centers.count() <= GROUP:
        unit = vectors.select(key, scaled(F.col(vector)).alias("__v"))
        row = centers.agg(F.collect_list(F.struct("topic_id", scaled(F.col("centroid")).alias("c"))).alias("__all"))
        scored = F.transform("__all", lambda c: F.struct(dot(F.col("__v"), c["c"]).alias("sim"), (-c["topic_id"]).alias("t")))
        found = unit.crossJoin(F.broadcast(row)).select(key, F.array_max(F.filter(scored, lambda s: s["sim"].isNotNull())).alias("best"))
    else:
        found = similarities(vectors, centers, key, vector).groupBy(key).agg(F.max(F.struct(F.col("sim"), (-F.col("topic_id")).alias("t"))).alias("best"))
    sim = F.col("best.sim")
    return found.select(key, F.when(sim >= threshold, -F.col("best.t")).alias("topic_id"), sim.alias("sim"))


def assign(vectors: DataFrame, centers: DataFrame, key: str, vector: str = "embedding", threshold: float = 0.7, shared_new_id: bool = False, top: int | None = None) -> DataFrame:
    """Like `nearest`, but what matches nothing gets new ids after the greatest (`top`, or that of the centres): one each,
    or one for all."""
    centers = stored(centers, "centres")
    found = stored(nearest(vectors, centers, key, vector, threshold), "matched")
    if top is None:
        top = centers.agg(F.max("topic_id")).first()[0] or 0
    fresh = found.where("topic_id is null")
    fresh = fresh.withColumn("n", F.lit(0)) if shared_new_id else numbered(fresh, [key])
    new = F.lit(top) + 1 + F.col("n")
    fresh = fresh.select(key, new.cast("int").alias("topic_id"), "sim", F.lit(True).alias("is_new"))
    return found.where("topic_id is not null").select(key, F.col("topic_id").cast("int").alias("topic_id"), "sim", F.lit(False).alias("is_new")).unionByName(fresh)


def renumber(rows: DataFrame, label: str, top: DataFrame) -> DataFrame:
    """New clusters get ids after the greatest topic id, in the order of their labels; -1 stays."""
    order = numbered(rows.where(F.col(label) >= 0).select(label).distinct(), [label])
    named = order.crossJoin(F.broadcast(top)).select(label, (F.col("top") + 1 + F.col("n")).cast("int").alias("topic_id"))
    return rows.join(named, label, "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))


def refine(vectors: DataFrame, centers: DataFrame, key: str, topic: int, vector: str = "embedding", margin: float = 0.1, threshold: float = 0.7) -> DataFrame:
    """For each vector of an over-large topic: key, own, best, best_topic, action. It moves if another topic is better by
    more than the margin, stays if its own similarity reaches the threshold, and is clustered anew otherwise."""
    mine = vectors.where(F.col("topic_id") == topic).select(key, vector)
    sims = similarities(mine, centers, key, vector)
    other = F.when(F.col("topic_id") != topic, F.struct("sim", (-F.col("topic_id")).alias("t")))
    wide = sims.groupBy(key).agg(F.max(F.when(F.col("topic_id") == topic, F.col("sim"))).alias("own"), F.max(other).alias("o"))
    wide = wide.select(key, "own", F.col("o.sim").alias("best"), (-F.col("o.t")).alias("best_topic"))
    action = F.when(F.col("best_topic").isNotNull() & (F.col("best") > F.col("own") + margin), "move").when(F.col("own") >= threshold, "keep").otherwise("recluster")
    return wide.withColumn("action", action)


def refined(actions: DataFrame, clustered: DataFrame, key: str, topic: int, top: int) -> DataFrame:
    """key, topic_id after a refinement: actions as `refine` gives them, clustered (key, cluster) for the vectors that
    were clustered anew. Those get ids after the greatest, in the order of their clusters; noise becomes -1."""
    fresh = renumber(clustered.select(key, "cluster"), "cluster", clustered.sparkSession.createDataFrame([(top,)], "top int")).select(key, F.col("topic_id").alias("new"))
    topic_id = F.when(F.col("action") == "move", F.col("best_topic")).when(F.col("action") == "keep", F.lit(topic)).otherwise(F.coalesce("new", F.lit(-1)))
    return actions.join(fresh, key, "left").select(key, topic_id.cast("int").alias("topic_id"), "action")


def keep_closest(sims: DataFrame, keys: list[str], sim: str = "sim", part: float = 0.8, accuracy: int | None = None) -> DataFrame:
    """Rows at or above the given percentile of their group; with an accuracy, an approximate percentile, whose state stays
    small however large a group is."""
    cut = sims.groupBy(*keys).agg((F.percentile(sim, part) if accuracy is None else F.percentile_approx(sim, part, accuracy)).alias("cut"))
    return sims.join(cut, keys).where(F.col(sim) >= F.col("cut"))


def keyword_labels(keywords: DataFrame, topic: str = "topic_id", n: int = 5) -> DataFrame:
    """topic, label: its n most frequent keywords, ties by keyword; `Outliers` for -1."""
    counts = keywords.groupBy(topic, "keyword").agg(F.count("*").alias("cnt"))
    order = W.partitionBy(topic).orderBy(F.col("cnt").desc(), "keyword")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "keyword"))), lambda s: s["keyword"]), ", ")
    return top.groupBy(topic).agg(joined.alias("words")).select(topic, F.when(F.col(topic) == -1, "Outliers").otherwise(F.col("words")).alias("label"))


def class_tf_idf(tokens: DataFrame, label: str) -> DataFrame:
    """label, token, tf, score: tokens that set a class apart. tokens has a row for each (label, token) occurrence. They are counted once and stored,
    since all sums are of the counts."""
    tf = stored(tokens.groupBy(label, "token").agg(F.count("*").alias("tf")), "class-counts")
    per_class = tf.groupBy(label).agg(F.sum("tf").alias("words"))
    everywhere = tf.groupBy("token").agg(F.sum("tf").alias("freq"))
    mean = per_class.agg(F.avg("words").alias("mean_words"))
    joined = tf.join(per_class, label).join(everywhere, "token").crossJoin(F.broadcast(mean))
    return joined.withColumn("score", F.col("tf").cast("double") / F.col("words") * F.log(1 + F.col("mean_words") / F.col("freq")))


def similarity(a: Column, b: Column) -> Column:
    return cosine(a, b)
