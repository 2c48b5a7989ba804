"""Structured Streaming forms of ingest, counts, enrichment and topic assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rostrum.operators.enrich import plan_ingest, upsert
from rostrum.operators.topics import assign


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, with a timestamp that watermarks accept."""
    return arriving(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def session_files(spark: SparkSession, base: str, pattern: str = "*.txt") -> DataFrame:
    """Whole transcript files as they arrive: path, content."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def windowed_counts(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day", *keys: str) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = stream.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def session_counts(stream: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def once_by_id(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def enriched(stream: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Stream rows with a static dimension's columns."""
    return stream.join(dimension, keys, "left")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Works off what is there and stops; the checkpoint remembers it for the next run."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", path)).start()
    query.awaitTermination()
    return query


def complete_result(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The final table of a complete-mode aggregate over what is there now, written by each batch as a whole."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run_once(stream, path, checkpoint, "complete", sink)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest_sink(spark: SparkSession, store: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """Upserts each batch into a versioned Parquet store: a batch writes version n from the last before it, never onto itself,
    so a repeated batch writes the same version again."""

    def sink(batch: DataFrame, n: int) -> None:
        latest = batch.dropDuplicates([key])
        earlier = [v for v in versions(spark, store) if v < n]
        merged = upsert(spark.read.schema(batch.schema).parquet(f"{store}/v{earlier[-1]}"), latest, key) if earlier else latest
        merged.write.mode("overwrite").parquet(f"{store}/v{n}")

    return sink


def versions(spark: SparkSession, store: str) -> list[int]:
    """The versions that batches have written, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current(spark: SparkSession, store: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A version of the store, the last by default; empty where no batch has come yet."""
    found = versions(spark, store)
    if version is None and not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/v{found[-1] if version is None else version}")


def topic_sink(spark: SparkSession, store: str, centers: DataFrame, key: str, threshold: float) -> Callable[[DataFrame, int], None]:
    """Assigns each batch to the known centres and writes it as a version of its own; new ids go on from the greatest that
    the centres and earlier batches have, so batches share none."""

    def sink(batch: DataFrame, n: int) -> None:
        earlier = [v for v in versions(spark, store) if v < n]
        seen = spark.read.parquet(*[f"{store}/v{v}" for v in earlier]).agg(F.max("topic_id")).first()[0] if earlier else None
        top = max(centers.agg(F.max("topic_id")).first()[0] or 0, seen or 0)
        assign(batch, centers, key, threshold=threshold, top=top).write.mode("overwrite").parquet(f"{store}/v{n}")

    return sink


def all_versions(spark: SparkSession, store: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches of an appending store."""
    found = versions(spark, store)
    return spark.read.schema(schema).parquet(*[f"{store}/v{v}" for v in found]) if found else spark.createDataFrame([], schema)


def dry_run(arriving: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return plan_ingest(arriving, stored, key).groupBy("action").agg(F.count("*").alias("n"))


def day(column: str) -> Column:
    return F.date_trunc("day", F.col(column))
