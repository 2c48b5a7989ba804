"""The speech corpus as views over a star schema, in DataFrame form and as portable SQL for an independent oracle.

One order is one speech; customers speak, nations are provinces, parts of line items are named entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.schema import CALENDAR, CALENDAR_SCHEMA
from rostrum.sources.store import file_states, fresh_path

SPEECHES_SQL = """speeches AS (
SELECT concat('term', o.term, '-year', o.yr, '-session', o.doy, '-', o.o_orderkey) AS id, o.o_orderkey AS speech_key,
       concat('term', o.term, '-year', o.yr, '-session', o.doy) AS session_id, o.term AS term, o.yr AS year,
       c.c_name AS speech_giver, n.n_name AS province,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS political_party_at_time,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 12 AS INT) - 1 END AS topic_id,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
            ELSE concat('topic ', CAST(o.o_orderkey % 12 AS INT) - 1, CASE WHEN o.o_orderkey % 5 = 0 THEN ' alt' ELSE '' END) END AS topic_label,
       CAST(o.o_orderdate AS DATE) AS session_date, d.text AS content
FROM (SELECT *, CAST(year(o_orderdate) - 1978 AS INT) AS term, CAST(quarter(o_orderdate) AS INT) AS yr, CAST(dayofyear(o_orderdate) AS INT) AS doy FROM orders) o
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN documents d ON d.doc_id = o.o_orderkey)"""
ENTITIES_SQL = """entities AS (
SELECT l.l_orderkey AS speech_key, p.p_brand AS entity, CASE l.l_returnflag WHEN 'A' THEN 'PER' WHEN 'N' THEN 'LOC' ELSE 'ORG' END AS entity_group,
       CAST(count(*) AS INT) AS frequency, round(1 - avg(l.l_discount), 4) AS confidence,
       CASE WHEN max(l.l_linestatus) = 'F' THEN concat('https://example.org/', p.p_brand) END AS wikipedia_url
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2, 3)"""
MPS_SQL = """mps AS (
SELECT DISTINCT CAST(year(o.o_orderdate) - 1978 AS INT) AS term, c.c_name AS mp_name, c.c_mktsegment AS party FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""
KEYWORDS_SQL = """keywords AS (
SELECT DISTINCT l.l_orderkey AS speech_key, unnest(string_split(p.p_name, ' ')) AS keyword FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""
CALENDAR_SQL = "calendar AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, {y}, {a}, {b})" for t, y, a, b in CALENDAR) + ") AS c(term, year, year_from, year_to))"
TOKENS_SQL = r"tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents)"
VIEWS = {"speeches": SPEECHES_SQL, "entities": ENTITIES_SQL, "mps": MPS_SQL, "keywords": KEYWORDS_SQL, "calendar": CALENDAR_SQL, "tokens": TOKENS_SQL}


def with_views(body: str, *names: str) -> str:
    """SQL that begins with the named views; body is a select or starts with further views."""
    head = ",\n".join(VIEWS[n] for n in names)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCES = ("orders", "customer", "nation")
_stored: dict[tuple[str, str], tuple[list[tuple], str]] = {}


def speeches(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """The speech table, typed and partitioned by term and year. It is derived and written once for an application and a
    folder, and again when its source files change; queries read it, so that filters on term and year prune partitions
    and others reach the files. Texts are joined only where content is asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    derived = _derived(spark, sf_dir)
    state = [f for name in SOURCES for f in file_states(spark, f"{sf_dir}/{name}.parquet")]
    if key not in _stored or _stored[key][0] != state:
        path = fresh_path(spark, "speeches")
        derived.repartition("term", "year").sortWithinPartitions("session_date").write.partitionBy("term", "year").parquet(path)
        _stored[key] = state, path
    rows = spark.read.schema(derived.schema).parquet(_stored[key][1]).select(*derived.columns)
    if content:
        texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("speech_key"), F.col("text").alias("content"))
        rows = rows.join(texts, "speech_key", "left")
    return rows


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda n: table(spark, sf_dir, n)
    at = F.col("o_orderdate")
    orders = get("orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.year(at) - 1978).alias("term"), F.quarter(at).alias("year"), F.dayofyear(at).alias("doy"))
    rows = orders.join(get("customer"), orders.o_custkey == F.col("c_custkey")).join(F.broadcast(get("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key, named = F.col("o_orderkey"), F.col("o_orderkey") % 13 != 0
    topic = (key % 12).cast("int") - 1
    session = F.concat(F.lit("term"), "term", F.lit("-year"), "year", F.lit("-session"), "doy")
    return rows.select(
        F.concat(session, F.lit("-"), key).alias("id"), key.alias("speech_key"), session.alias("session_id"), "term", "year", F.col("c_name").alias("speech_giver"), F.col("n_name").alias("province"),
        F.when(key % 11 != 0, F.col("c_mktsegment")).alias("political_party_at_time"), F.when(named, topic).alias("topic_id"),
        F.when(named, F.concat(F.lit("topic "), topic, F.when(key % 5 == 0, " alt").otherwise(""))).alias("topic_label"), F.col("o_orderdate").cast("date").alias("session_date"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named entities of speeches, a row for each speech, entity and type."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "A", "PER").when(F.col("l_returnflag") == "N", "LOC").otherwise("ORG")
    grouped = lines.groupBy(F.col("l_orderkey").alias("speech_key"), F.col("p_brand").alias("entity"), kind.alias("entity_group"))
    return grouped.agg(F.count("*").cast("int").alias("frequency"), F.round(1 - F.avg("l_discount"), 4).alias("confidence"), F.when(F.max("l_linestatus") == "F", F.concat(F.lit("https://example.org/"), F.col("entity"))).alias("wikipedia_url"))


def nested_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """speech_key and ner_entities, sorted by entity and type."""
    element = F.struct("entity", "entity_group", "frequency", "wikipedia_url", "confidence")
    return entities(spark, sf_dir).groupBy("speech_key").agg(F.array_sort(F.collect_list(element)).alias("ner_entities"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, mp_name, party."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") - 1978).alias("term")).distinct()
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("term", F.col("c_name").alias("mp_name"), F.col("c_mktsegment").alias("party"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """speech_key and keyword, distinct."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("speech_key"), F.explode(F.split("p_name", " ")).alias("keyword")).distinct()


def calendar(spark: SparkSession) -> DataFrame:
    """term, year, year_from, year_to: the fixed dimension of terms and their calendar years."""
    return spark.createDataFrame(CALENDAR, CALENDAR_SCHEMA)
