"""Documents whose fields differ: variants, the paths and types that stand in them, backup and restore without a schema.

A document is JSON text. Its parts are unfolded level by level by the engine's own variant functions, so a path that one
document in a billion has is seen, and no schema is inferred from a sample. Text that is no JSON is counted under the type
`malformed` at the root. Steps into arrays are written [], names that aren't plain words in quotes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.store import stored

#: JSON types by the names that variants use (fixed values).
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), name), F.lit("number"))


def field_report(docs: DataFrame, key: str, text: str) -> DataFrame:
    """path, type, documents (that have it), values (times it stands there), over all levels of all documents."""
    spark = docs.sparkSession
    parsed = docs.select(F.col(key).alias("key"), F.try_parse_json(text).alias("v"), F.col(text).isNotNull().alias("there")).where("there")
    level = stored(parsed.select("key", F.lit("$").alias("path"), "v", F.when(F.col("v").isNull(), "malformed").otherwise(kind(F.col("v"))).alias("type")), "documents")
    counts: list[DataFrame] = []
    while level.limit(1).count():
        each = level.groupBy("key", "path", "type").agg(F.count("*").alias("n"))
        counts.append(each.groupBy("path", "type").agg(F.count("*").alias("documents"), F.sum("n").alias("values")))
        inner = level.where(F.col("type").isin("object", "array")).select("key", "path", "v")
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("at", "name", "part"))
        name = F.when(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("name")).otherwise(F.concat(F.lit('"'), "name", F.lit('"')))
        path = F.concat("path", F.when(F.col("name").isNull(), "[]").otherwise(F.concat(F.lit("."), name)))
        level = stored(parts.select("key", path.alias("path"), F.col("part").alias("v"), kind(F.col("part")).alias("type")), "documents")
    if not counts:
        return spark.createDataFrame([], "path string, type string, documents long, values long")
    return reduce(DataFrame.union, counts)


def has(text: str, path: str) -> Column:
    """Whether a document holds something other than null at a path such as $.a.b or $.a[0]."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def first_with(docs: DataFrame, key: str, text: str, paths: list[str]) -> DataFrame:
    """The document with the least key that has all of the paths: one row or none."""
    able = docs.where(F.col(key).isNotNull() & reduce(lambda a, b: a & b, [has(text, p) for p in paths]))
    return able.groupBy().agg(F.min_by(F.struct(key, text), key).alias("x")).where("x is not null").select("x.*")


def backup(docs: DataFrame, key: str, text: str, path: str) -> None:
    """A line of JSON for each document: its key and its source, whatever fields that has (in the order of their
    names); malformed ones are left out."""
    source = F.try_parse_json(text)
    own = F.to_json(F.array(key))
    line = F.concat(F.lit('{"_id":'), own.substr(F.lit(2), F.length(own) - 2), F.lit(',"_source":'), F.to_json(source), F.lit("}"))
    docs.where(source.isNotNull()).select(line.alias("value")).write.text(path)


def restore(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """key, text of the documents of a backup; text is their source as compact JSON."""
    line = F.parse_json("value")
    return spark.read.text(path).select(F.variant_get(line, "$._id", key_type).alias("key"), F.to_json(F.variant_get(line, "$._source", "variant")).alias("text"))
