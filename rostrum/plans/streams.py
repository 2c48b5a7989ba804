"""Streaming queries (X), run over the event table to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import topics
from rostrum.plans.aggregates import CENTRE_SQL, NEAREST_SQL
from rostrum.plans.registry import query
from rostrum.sources.fixtures import speeches, table
from rostrum.sources.store import fresh_path
from rostrum.streaming import founding, stream


def _places(spark) -> tuple[str, str]:
    """A result and a checkpoint folder, in the shared store where the session names one."""
    run = fresh_path(spark, "stream")
    return f"{run}/out", f"{run}/checkpoint"


@query("X1_incremental_ingest", "SELECT user_id, count(*) AS events, max(event_id) AS latest FROM events GROUP BY 1")
def x1(spark, d):
    """Events arrive once, each user's latest is upserted."""
    out, checkpoint = _places(spark)
    counts = stream.events(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("latest"))
    stream.run_once(counts, out, checkpoint, "update", stream.ingest_sink(spark, out, "user_id"))
    return stream.current(spark, out, counts.schema)


@query("X2_once_by_id", "SELECT count(DISTINCT event_id) AS n FROM events")
def x2(spark, d):
    out, checkpoint = _places(spark)
    twice = stream.events(spark, d)
    once = stream.once_by_id(twice.union(stream.events(spark, d)), "event_id").select("event_id")
    stream.run_once(once, out, checkpoint)
    return spark.read.schema(once.schema).parquet(out).agg(F.count("*").alias("n"))


@query("X3_daily_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x3(spark, d):
    counts = stream.windowed_counts(stream.events(spark, d), "1 day", None, "1 day", "event_type")
    done = stream.complete_result(counts, *_places(spark))
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("X3_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, count(*) AS n, min(ts) AS session_start FROM g GROUP BY user_id, k")
def x3_sessions(spark, d):
    counts = stream.session_counts(stream.events(spark, d), "2 hours", "1 day", "user_id")
    done = stream.complete_result(counts, *_places(spark))
    return done.select("user_id", "n", F.col("session_start").cast("timestamp_ntz").alias("session_start"))


@query("X4_running_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def x4(spark, d):
    return stream.complete_result(stream.running_counts(stream.events(spark, d), "event_type", "user_id"), *_places(spark))


@query("X5_stream_static", "SELECT c.c_mktsegment AS party, count(*) AS n FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id GROUP BY 1")
def x5(spark, d):
    dimension = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("party"))
    joined = stream.enriched(stream.events(spark, d), dimension, ["user_id"])
    return stream.complete_result(stream.running_counts(joined, "party"), *_places(spark))


@query("X6_dry_run", "SELECT CASE WHEN s.speech_key IS NULL THEN 'insert' ELSE 'update' END AS action, count(*) AS n FROM (SELECT event_id * 2 AS speech_key FROM events) e LEFT JOIN speeches s ON s.speech_key = e.speech_key GROUP BY 1", "speeches")
def x6(spark, d):
    arriving = table(spark, d, "events").select((F.col("event_id") * 2).alias("speech_key"))
    return stream.dry_run(arriving, speeches(spark, d).select("speech_key"), "speech_key")


@query("X7_stream_topics", f"WITH {CENTRE_SQL}, {NEAREST_SQL}, n AS (SELECT *, sim < 0.25 AS is_new FROM near) SELECT vec_id, CAST(CASE WHEN is_new THEN (SELECT max(topic_id) FROM centre) + row_number() OVER (PARTITION BY is_new ORDER BY vec_id) ELSE topic_id END AS INT) AS topic_id, round(sim, 6) AS sim, is_new FROM n")
def x7(spark, d):
    """Vectors arrive as a stream and take the topic of the nearest known centre."""
    out, checkpoint = _places(spark)
    known = table(spark, d, "embeddings").withColumnRenamed("label", "topic_id")
    centers = topics.centroids(known)
    arriving = stream.arriving(spark, d, "embeddings")
    stream.run_once(arriving.select("vec_id", "embedding"), out, checkpoint, "append", stream.topic_sink(spark, out, centers, "vec_id", 0.25))
    return stream.all_versions(spark, out, "vec_id long, topic_id int, sim double, is_new boolean").withColumn("sim", F.round("sim", 6))


@query("X7_founded_topics")
def x7_founded(spark, d):
    """Vectors arrive a minute apart; those that match no known centre found topics, which expire after a day."""
    out, checkpoint = _places(spark)
    known = table(spark, d, "embeddings").withColumnRenamed("label", "topic_id")
    arriving = stream.arriving(spark, d, "embeddings")
    timed = arriving.withColumn("ts", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("vec_id") * 60))
    with founding.rocksdb_state(spark):
        stream.run_once(founding.founded_topics(timed, topics.centroids(known), "vec_id", threshold=0.25, ttl="1 day"), out, checkpoint)
    return spark.read.schema("vec_id long, topic_id long, sim double, is_new boolean, members long").parquet(out).withColumn("sim", F.round("sim", 6))
