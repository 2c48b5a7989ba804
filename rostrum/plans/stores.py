"""Stored copies in step, cubes of sketches, documents with differing fields, selection of exact percentiles (S, A, M, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import inference, selection, sketches
from rostrum.plans.registry import query
from rostrum.sources import documents
from rostrum.sources.fixtures import speeches, table
from rostrum.sources.store import fresh_path, stored
from rostrum.sources.sync import Replica

STALE_SQL = "CASE WHEN speech_key % 97 = 0 THEN NULL WHEN speech_key % 50 = 0 THEN 'stale' ELSE topic_label END"


@query("S10_anti_entropy", f"SELECT count(*) FILTER (topic_label IS NOT NULL AND topic_label IS DISTINCT FROM old) AS changed, true AS equal FROM (SELECT topic_label, CASE WHEN topic_label IS NOT NULL THEN {STALE_SQL} END AS old FROM speeches)", "speeches")
def s10_anti_entropy(spark, d):
    """A copy with stale and missing labels takes over those of its source; both roots are equal after."""
    rows = speeches(spark, d).select("speech_key", "topic_label")
    copies = []
    for label in ("topic_label", f"CASE WHEN topic_label IS NOT NULL THEN {STALE_SQL} END"):
        made = Replica(spark, fresh_path(spark, "replica"), "speech_key", ["topic_label"], 32)
        made.create(rows.select("speech_key", F.expr(label).alias("topic_label")))
        copies.append(made)
    found = copies[1].pull(copies[0])
    return spark.createDataFrame([(found["changed"], found["equal"])], "changed long, equal boolean")


def _cells(spark, d, *keys):
    return stored(sketches.cube(speeches(spark, d), *keys), "cube")


@query("A9_sketch_stats", "SELECT count(*) AS speeches, min(term) AS first_term, max(term) AS last_term, min(year) AS first_year, max(year) AS last_year, true AS sessions_near, true AS members_near, true AS topics_near, true AS recent_near FROM speeches WHERE term BETWEEN 15 AND 19", "speeches")
def a9_sketch(spark, d):
    """Statistics of five terms from the cube; distinct counts are held against exact ones and lie within 2 %."""
    found = sketches.index_stats(_cells(spark, d, "term", "year").where("term between 15 and 19"))
    rows = speeches(spark, d).where("term between 15 and 19")
    topic = F.when(~F.col("topic_id").isin(-1, 1), F.col("topic_id"))
    exact = rows.agg(F.count_distinct("session_id").alias("s"), F.count_distinct("speech_giver").alias("m"), F.count_distinct(topic).alias("t"), F.count_distinct(F.when(F.col("term") >= 17, F.col("speech_giver"))).alias("r"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.02 * F.col(b)
    both = found.crossJoin(F.broadcast(exact))
    return both.select("speeches", "first_term", "last_term", "first_year", "last_year", near("sessions", "s").alias("sessions_near"), near("members", "m").alias("members_near"), near("topics", "t").alias("topics_near"), near("recent_members", "r").alias("recent_near"))


@query("A7_sketch_facets", "SELECT 'province' AS facet, province AS value, count(*) AS cnt FROM speeches WHERE year = 2 GROUP BY 2 UNION ALL SELECT 'political_party_at_time', political_party_at_time, count(*) FROM speeches WHERE year = 2 AND political_party_at_time IS NOT NULL GROUP BY 2", "speeches")
def a7_sketch(spark, d):
    """Two facets of all second years from the cube's lists."""
    cells = _cells(spark, d, "term", "year").where("year = 2")
    of = lambda c: sketches.top_values(cells, c, 100).select(F.lit(c).alias("facet"), F.col("value").cast("string").alias("value"), "cnt")
    return of("province").unionByName(of("political_party_at_time"))


@query("A14_sketch_provinces", "SELECT province, count(*) AS speeches, true AS near FROM speeches WHERE term >= 16 GROUP BY 1", "speeches")
def a14_sketch(spark, d):
    """Speeches and members of provinces since a term from the cube; members lie within 2 % of the exact count."""
    found = sketches.busiest(_cells(spark, d, "term", "year", "province").where("term >= 16"))
    exact = speeches(spark, d).where("term >= 16").groupBy("province").agg(F.count_distinct("speech_giver").alias("exact"))
    return found.join(exact, "province").select("province", "speeches", (F.abs(F.col("members") - F.col("exact")) <= 0.02 * F.col("exact")).alias("near"))


#: A document for each order; which fields it has, and of which types, depends on its key. Both engines read this text.
MIXED = """concat('{', CASE WHEN o_orderkey % 5 = 0 THEN '"a note":null,' ELSE '' END, '"id":', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ',"score":1.5' ELSE ',"score":"high"' END,
CASE WHEN o_orderkey % 4 = 0 THEN concat(',"tags":["x",', o_orderkey, ',{"deep":[true,null]}]') ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN concat(',"topic":{"id":', o_orderkey % 12, ',"label":"topic ', o_orderkey % 12, '"}') ELSE '' END,
CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE '}' END)"""


def mixed(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(MIXED).alias("doc"))


@query("S14_document_fields", f"WITH j AS (SELECT o_orderkey, {MIXED} AS doc FROM orders), t AS (SELECT o_orderkey, regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type FROM j, json_tree(CASE WHEN o_orderkey % 101 = 0 THEN 'null' ELSE doc END) WHERE o_orderkey % 101 <> 0 UNION ALL SELECT o_orderkey, '$', 'malformed' FROM j WHERE o_orderkey % 101 = 0) SELECT path, type, count(DISTINCT o_orderkey) AS documents, count(*) AS \"values\" FROM t GROUP BY 1, 2")
def s14_fields(spark, d):
    """Every path and type of documents that share no schema."""
    return documents.field_report(mixed(spark, d), "o_orderkey", "doc")


@query("S14_first_with_fields", f"SELECT o_orderkey, {MIXED} AS doc FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 12 = 0 AND o_orderkey % 101 <> 0 AND o_orderkey > 0)")
def s14_first(spark, d):
    return documents.first_with(mixed(spark, d), "o_orderkey", "doc", ["$.topic.label", "$.tags[2].deep[0]", "$.score"])


@query("S12_backup_documents", f"SELECT o_orderkey AS key, {MIXED} AS text FROM orders WHERE o_orderkey % 101 <> 0")
def s12_documents(spark, d):
    """Documents with differing fields to lines of JSON and back."""
    path = fresh_path(spark, "backup")
    documents.backup(mixed(spark, d), "o_orderkey", "doc", path)
    return documents.restore(spark, path)


@query("M4_exact_percentiles", "SELECT l_returnflag, l_linestatus, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.8) AS cut FROM lineitem GROUP BY 1, 2 UNION ALL SELECT 'all', NULL, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.8) FROM lineitem")
def m4_percentiles(spark, d):
    """The same percentile of groups and of all rows as one group, by distributed selection."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    whole = selection.exact_percentile(rows.withColumn("l_returnflag", F.lit("all")).withColumn("l_linestatus", F.lit(None).cast("string")), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.8)
    return selection.exact_percentile(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.8).unionByName(whole)


def first_words_model():
    """Stands in for a model: two words of each text; it can't read texts whose length 9 divides."""

    def model(texts):
        if any(len(t) % 9 == 0 for t in texts):
            raise ValueError("unreadable")
        return [" ".join(t.split(" ")[:2]) for t in texts]

    return model


@query("M1_model_batches", "SELECT doc_id, CASE WHEN length(text) % 9 <> 0 THEN array_to_string(string_split(text, ' ')[1:2], ' ') END AS result, CASE WHEN length(text) % 9 = 0 THEN 'ValueError: unreadable' END AS error FROM documents")
def m1_model(spark, d):
    """A model over all documents in batches; the second call finds every answer in the table and asks none."""
    docs, path = table(spark, d, "documents"), fresh_path(spark, "model-results")
    for _ in range(2):
        found = inference.with_model(docs, "text", first_words_model, path, "two-words")
    return found.select("doc_id", "result", "error")
