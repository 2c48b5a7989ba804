"""Files in and out: transcripts, dimension tables, vectors, exports, schema reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.functions.text import one_spaced

#: Files that hold no speeches (fixed values).
SKIPPED = r"(fih|gnd)\.txt$"


def transcripts(spark: SparkSession, base: str, term: int | None = None, year: int | None = None, pattern: str = "*.{txt,mmd}") -> DataFrame:
    """path, dir, name, term, year, content of whole session files in either layout: `.../*.txt` or `.../result.mmd`.
    Term and year are read from folders named d<term>-y<year>."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    path = F.col("_metadata.file_path")
    rows = rows.select(path.alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(SKIPPED))
    rows = rows.where(F.col("path").rlike(r"\.txt$") | F.col("path").rlike(r"/result\.mmd$"))
    part = lambda p: F.regexp_extract("path", p, 1)
    name = F.when(F.endswith("path", F.lit("/result.mmd")), part(r"/([^/]+)/result\.mmd$")).otherwise(part(r"/([^/]+)$"))
    rows = rows.select("path", part(r"^(.*)/[^/]+$").alias("dir"), name.alias("name"), part(r"[/=]d(\d+)-?y\d+").try_cast("int").alias("term"), part(r"[/=]d\d+-?y(\d+)").try_cast("int").alias("year"), "content")
    wanted = [F.col(c) == v for c, v in (("term", term), ("year", year)) if v is not None]
    return rows.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))


def census(spark: SparkSession, base: str, pattern: str = "*.txt") -> DataFrame:
    """dir, counted, excluded: files by folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base).select("path")
    skipped = F.col("path").rlike(SKIPPED)
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir")).agg(F.count_if(~skipped).alias("counted"), F.count_if(skipped).alias("excluded"))


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header: text trimmed and single-spaced; a value that isn't of its type fails the read."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)
    return rows.select(*[one_spaced(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema.fields])


def int_list(raw: Column) -> Column:
    """`[17, 18]` or `17` as an array; null for anything else."""
    one = raw.try_cast("int")
    return F.coalesce(F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<int>")), F.when(one.isNotNull(), F.array(one)))


def load_vectors(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Vectors of the given ids, joined by key, never by position."""
    return vectors.join(ids, key)


def append_vectors(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds those vectors whose key is not there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def export_csv(df: DataFrame, path: str) -> None:
    """Array columns as comma lists, since CSV has none."""
    flat = [F.concat(F.lit("["), F.array_join(F.transform(f.name, lambda x: x.cast("string")), ", "), F.lit("]")).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_speeches(df: DataFrame, path: str) -> None:
    """The speech table by term and year, so that scans of a period read nothing else."""
    df.repartition("term", "year").write.mode("overwrite").partitionBy("term", "year").parquet(path)


def _flat(kind: T.DataType, at: str) -> list[tuple[str, str]]:
    if isinstance(kind, T.StructType):
        return [row for f in kind.fields for row in [(f"{at}{f.name}", f.dataType.simpleString()), *_flat(f.dataType, f"{at}{f.name}.")]]
    if isinstance(kind, T.ArrayType):
        return _flat(kind.elementType, at[:-1] + "[].")
    return []


def schema_rows(df: DataFrame) -> DataFrame:
    """field, type: the table's schema with nested fields, and how many rows have each top field."""
    rows = _flat(df.schema, "")
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "field", "present")
    return df.sparkSession.createDataFrame(rows, "field string, type string").join(F.broadcast(counts), "field", "left")


def richest(df: DataFrame, groups: list[list[str]], key: str) -> DataFrame:
    """One row with the most of the groups of columns present; earlier groups weigh more, ties by key."""
    has = lambda g: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in g])
    score = reduce(lambda a, b: a + b, [has(g).cast("int") * (1 << (len(groups) - i)) for i, g in enumerate(groups)])
    return df.withColumn("richness", score).orderBy(F.col("richness").desc(), key).limit(1)
