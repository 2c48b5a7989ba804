"""Scans, projections and filters over speeches (S and P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import dates, names
from rostrum.operators import enrich, extract, search
from rostrum.plans.registry import query
from rostrum.sources import files
from rostrum.sources.fixtures import entities, keywords, members, nested_entities, speeches, table
from rostrum.sources.store import fresh_path
from rostrum.sources.versioned import StoredTable

MEMBERS_SQL = "m AS (SELECT mp_name, list_sort(list(term)) AS terms FROM mps GROUP BY 1)"


def member_terms(spark, d):
    return members(spark, d).groupBy("mp_name").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def stringified(spark, d):
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit("["), F.year("o_orderdate"), F.lit(", "), F.month("o_orderdate"), F.lit("]"))).when(key % 3 == 1, F.year("o_orderdate").cast("string")).otherwise("none")
    return table(spark, d, "orders").select(key, raw.alias("raw"))


@query("S4_list_columns", "SELECT o_orderkey, CAST(coalesce(len(l), 0) AS INT) AS n, l[1] AS first FROM (SELECT o_orderkey, coalesce(TRY_CAST(raw AS INT[]), CASE WHEN TRY_CAST(raw AS INT) IS NOT NULL THEN [TRY_CAST(raw AS INT)] END) AS l FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('[', year(o_orderdate), ', ', month(o_orderdate), ']') WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'none' END AS raw FROM orders))")
def s4(spark, d):
    listed = stringified(spark, d).withColumn("l", files.int_list(F.col("raw")))
    return listed.select("o_orderkey", F.coalesce(F.when(F.col("l").isNotNull(), F.size("l")), F.lit(0)).alias("n"), F.get("l", F.lit(0)).alias("first"))


@query("S5_scan", "SELECT id, speech_giver, term, CAST(length(content) AS INT) AS chars FROM speeches WHERE length(trim(content)) > 0 AND topic_id IS NULL", "speeches")
def s5(spark, d):
    rows = search.with_text(speeches(spark, d, content=True)).where("topic_id is null")
    return rows.select("id", "speech_giver", "term", F.length("content").alias("chars"))


@query("S6_embeddings", "SELECT s.id, e.label, CAST(len(e.embedding) AS INT) AS dims, CAST(e.embedding[1] AS DOUBLE) AS head FROM embeddings e JOIN speeches s ON s.speech_key = e.vec_id", "speeches")
def s6(spark, d):
    vectors = files.load_vectors(table(spark, d, "embeddings"), speeches(spark, d).select(F.col("speech_key").alias("vec_id"), "id"), "vec_id")
    return vectors.select("id", "label", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).cast("double").alias("head"))


def stored_speeches(spark, d, *columns: str) -> StoredTable:
    """A stored table of these columns, with a folder for each term and year."""
    held = StoredTable(spark, fresh_path(spark, "speech-store"))
    held.create(speeches(spark, d).select(*columns, "term", "year"), "speech_key", ["term", "year"])
    return held


@query("S7_upsert", "WITH fresh AS (SELECT (SELECT max(o_orderkey) FROM orders) - 499 + doc_id AS speech_key, CASE WHEN n_chars % 2 = 0 THEN lang END AS topic_label FROM documents) SELECT coalesce(s.speech_key, f.speech_key) AS speech_key, s.speech_giver, s.topic_id, coalesce(f.topic_label, s.topic_label) AS topic_label FROM speeches s FULL JOIN fresh f ON f.speech_key = s.speech_key", "speeches")
def s7(spark, d):
    """Documents are merged into a stored table; the query reads the version that the merge made."""
    held = stored_speeches(spark, d, "speech_key", "speech_giver", "topic_id", "topic_label")
    top = table(spark, d, "orders").agg(F.max("o_orderkey").alias("top"))
    fresh = table(spark, d, "documents").crossJoin(F.broadcast(top)).select((F.col("top") - 499 + F.col("doc_id")).alias("speech_key"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("topic_label"))
    return held.read(held.merge(fresh, writer="documents", batch=0)).select("speech_key", "speech_giver", "topic_id", "topic_label")


@query("S8_backfill", "SELECT s.id, coalesce(s.political_party_at_time, m.party) AS political_party_at_time FROM speeches s LEFT JOIN mps m ON m.term = s.term AND m.mp_name = s.speech_giver", "speeches", "mps")
def s8(spark, d):
    """Only rows without a party are looked up, and only their folders are written anew."""
    held = stored_speeches(spark, d, "speech_key", "id", "speech_giver", "political_party_at_time")
    open_ = held.read().where("political_party_at_time is null").select("speech_key", "term", "speech_giver")
    found = enrich.exact_party(open_, members(spark, d)).where("party is not null").select("speech_key", F.col("party").alias("political_party_at_time"))
    return held.read(held.update(found)).select("id", "political_party_at_time")


LABELS = [(4, "Budget"), (6, "Health"), (7, "topic 7")]


@query("S9_relabel", "WITH l AS (SELECT * FROM (VALUES (4, 'Budget'), (6, 'Health'), (7, 'topic 7')) AS t(topic_id, new_label)) SELECT s.topic_id, coalesce(l.new_label, s.topic_label) AS topic_label, count(*) AS n, count(*) FILTER (l.new_label IS NOT NULL AND l.new_label IS DISTINCT FROM s.topic_label) AS changed FROM speeches s LEFT JOIN l ON l.topic_id = s.topic_id GROUP BY 1, 2", "speeches")
def s9(spark, d):
    """The labels of three topics in a stored table; rows that have them already aren't written anew."""
    labels = spark.createDataFrame(LABELS, "topic_id int, new_label string")
    held = stored_speeches(spark, d, "speech_key", "topic_id", "topic_label")
    changed = enrich.relabel(held.read(), labels).where("changed").select("speech_key", "topic_label")
    before, after = held.manifest()["version"], held.update(changed)
    old = held.read(before).select("speech_key", F.col("topic_label").alias("was"))
    both = held.read(after).join(old, "speech_key").withColumn("changed", ~F.col("was").eqNullSafe(F.col("topic_label")))
    return both.groupBy("topic_id", "topic_label").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("S10_sync", "WITH src AS (SELECT speech_key, CASE WHEN term >= 20 THEN topic_label END AS topic_label FROM speeches), dst AS (SELECT speech_key, CASE WHEN term < 22 THEN topic_label END AS topic_label FROM speeches), synced AS (SELECT d.speech_key, coalesce(s.topic_label, d.topic_label) AS topic_label FROM dst d LEFT JOIN (SELECT * FROM src WHERE topic_label IS NOT NULL) s USING (speech_key)) SELECT (SELECT count(topic_label) FROM src) AS in_source, (SELECT count(topic_label) FROM dst) AS before, count(topic_label) AS after FROM synced", "speeches")
def s10(spark, d):
    rows = speeches(spark, d)
    source = rows.select("speech_key", F.when(F.col("term") >= 20, F.col("topic_label")).alias("topic_label"))
    target = rows.select("speech_key", F.when(F.col("term") < 22, F.col("topic_label")).alias("topic_label"))
    synced = enrich.upsert(target, source.where("topic_label is not null"), "speech_key")
    one = lambda df, name: df.agg(F.count("topic_label").alias(name))
    return one(source, "in_source").crossJoin(one(target, "before")).crossJoin(one(synced, "after"))


@query("S11_quarantine", "WITH r AS (SELECT o_orderkey, concat(lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0'), '.', lpad(CAST(o_orderkey % 15 AS VARCHAR), 2, '0'), '.', year(o_orderdate)) AS raw FROM orders) SELECT o_orderkey, CAST(try_strptime(raw, '%d.%m.%Y') AS DATE) AS session_date, CASE WHEN try_strptime(raw, '%d.%m.%Y') IS NULL THEN concat('bad date: ', raw) END AS reason FROM r")
def s11(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    raw = F.concat(two(F.col("o_custkey") % 40), F.lit("."), two(F.col("o_orderkey") % 15), F.lit("."), F.year("o_orderdate"))
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return enrich.quarantine(rows, "raw", dates.parsed(F.col("raw")), "session_date").drop("raw")


@query("S15_page_links", """WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS l FROM pages) SELECT page_id, CAST(no AS INT) AS no, h[no + 1] AS href, l[no + 1] AS label FROM (SELECT *, unnest(range(len(h))) AS no FROM x)""")
def s15(spark, d):
    return extract.page_links(table(spark, d, "pages"))


@query("S16_words", "SELECT DISTINCT keyword AS target_word FROM keywords", "keywords")
def s16(spark, d):
    return keywords(spark, d).select(F.col("keyword").alias("target_word")).distinct()


@query("P1_search", r"SELECT id, speech_giver, topic_id, session_date FROM speeches WHERE province = 'NATION_3' AND term >= 17 AND session_date BETWEEN DATE '1996-02-01' AND DATE '1999-12-31' AND political_party_at_time = 'BUILDING' ORDER BY term DESC, year DESC, id LIMIT 20", "speeches")
def p1(spark, d):
    found = search.search(speeches(spark, d), province="NATION_3", political_party="BUILDING", from_date="01.02.1996", to_date="31.12.1999")
    return found.select("id", "speech_giver", "topic_id", "session_date")


@query("P2_topic_precedence", "SELECT topic_label, count(*) AS n FROM speeches WHERE topic_id = 4 GROUP BY 1", "speeches")
def p2(spark, d):
    return speeches(spark, d).where(search.predicate(topic_id=4, topic_label="topic 6")).groupBy("topic_label").agg(F.count("*").alias("n"))


@query("P3_date_range", "SELECT id, session_date FROM speeches WHERE session_date >= DATE '1997-05-19'", "speeches")
def p3(spark, d):
    return speeches(spark, d).where(search.date_range(F.col("session_date"), "19.05.1997", None)).select("id", "session_date")


@query("P4_full_text", r"SELECT id, speech_giver FROM speeches WHERE list_has_any(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), ['pourquoi', 'ble', 'ver'])", "speeches")
def p4(spark, d):
    return speeches(spark, d, content=True).where(search.match_any_token(F.col("content"), "Pourquoi ble, ver")).select("id", "speech_giver")


@query("P5_terms_and_ranges", "SELECT province, count(*) AS n FROM speeches WHERE term >= 19 AND topic_label IS NOT NULL AND NOT coalesce(topic_id IN (-1, 1), false) AND year = 2 GROUP BY 1", "speeches")
def p5(spark, d):
    rows = search.visible(speeches(spark, d)).where("term >= 19 and topic_label is not null and year = 2")
    return rows.groupBy("province").agg(F.count("*").alias("n"))


@query("P5_sentinels_keep_missing", "SELECT topic_id, count(*) AS n FROM speeches WHERE NOT coalesce(topic_id IN (-1, 1), false) GROUP BY 1", "speeches")
def p5_missing(spark, d):
    return search.visible(speeches(spark, d)).groupBy("topic_id").agg(F.count("*").alias("n"))


@query("P6_terms_list", "WITH " + MEMBERS_SQL + " SELECT s.id, s.political_party_at_time FROM speeches s JOIN m ON m.mp_name = s.speech_giver WHERE s.political_party_at_time IN ('BUILDING', 'MACHINERY') AND list_has_any(m.terms, [17, 23])", "speeches", "mps")
def p6(spark, d):
    rows = speeches(spark, d).join(member_terms(spark, d).withColumnRenamed("mp_name", "speech_giver"), "speech_giver")
    return rows.where(F.col("political_party_at_time").isin("BUILDING", "MACHINERY") & F.arrays_overlap("terms", F.array(F.lit(17), F.lit(23)))).select("id", "political_party_at_time")


@query("P7_either_present", "SELECT id FROM speeches WHERE topic_id IS NOT NULL OR political_party_at_time IS NOT NULL", "speeches")
def p7(spark, d):
    return speeches(spark, d).where(F.col("topic_id").isNotNull() | F.col("political_party_at_time").isNotNull()).select("id")


@query("P8_entity_search", "SELECT DISTINCT speech_key FROM entities WHERE entity = 'Brand#7' AND entity_group = 'PER'", "entities")
def p8(spark, d):
    return search.by_entity(nested_entities(spark, d), "Brand#7", "PER").select("speech_key")


@query("P9_point_lookup", "SELECT id, speech_giver, province, topic_label FROM speeches WHERE id = (SELECT max(id) FROM speeches)", "speeches")
def p9(spark, d):
    rows = speeches(spark, d).select("id", "speech_giver", "province", "topic_label")
    return rows.join(F.broadcast(rows.agg(F.max("id").alias("id"))), "id")


@query("P10_hit_shape", "WITH " + MEMBERS_SQL + " SELECT s.id, regexp_replace(coalesce(s.political_party_at_time, concat(m.terms[1], '.dönem ', s.province)), '^\\d+\\.dönem\\s+', '') AS party, array_to_string(m.terms, ', ') AS terms FROM speeches s JOIN m ON m.mp_name = s.speech_giver", "speeches", "mps")
def p10(spark, d):
    rows = speeches(spark, d).join(member_terms(spark, d).withColumnRenamed("mp_name", "speech_giver").withColumnRenamed("terms", "terms_served"), "speech_giver")
    listed = rows.withColumn("political_party", F.array(F.concat(F.get("terms_served", F.lit(0)), F.lit(".dönem "), "province")))
    return search.shaped(listed).select("id", "party", "terms")


@query("P11_member_filter", "WITH " + MEMBERS_SQL + " SELECT mp_name, list_max(terms) AS last_term FROM m WHERE contains(lower(mp_name), lower('ER#0000001')) AND list_max(terms) >= 17", "mps")
def p11(spark, d):
    rows = search.served_since(member_terms(spark, d)).where(F.contains(F.lower("mp_name"), F.lower(F.lit("ER#0000001"))))
    return rows.select("mp_name", F.array_max("terms").alias("last_term"))


@query("P12_with_text", "SELECT id FROM speeches WHERE length(trim(content)) > 0", "speeches")
def p12(spark, d):
    return search.with_text(speeches(spark, d, content=True)).select("id")


@query("P13_work_left", "SELECT count(*) FILTER (topic_id IS NULL) AS no_topic, count(*) FILTER (content IS NULL) AS no_text, count(*) FILTER (e.vec_id IS NULL) AS no_embedding, count(*) FILTER (x.speech_key IS NULL) AS no_entities, count(*) FILTER (x.open) AS links_missing FROM speeches s LEFT JOIN embeddings e ON e.vec_id = s.speech_key LEFT JOIN (SELECT speech_key, bool_or(coalesce(wikipedia_url, '') = '') AS open FROM entities GROUP BY 1) x ON x.speech_key = s.speech_key", "speeches", "entities")
def p13(spark, d):
    rows = speeches(spark, d, content=True).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("speech_key"), F.lit(1).alias("vec")), "speech_key", "left").join(nested_entities(spark, d), "speech_key", "left")
    missing = F.exists("ner_entities", lambda e: F.coalesce(e["wikipedia_url"], F.lit("")) == "")
    return rows.agg(F.count_if(F.col("topic_id").isNull()).alias("no_topic"), F.count_if(F.col("content").isNull()).alias("no_text"), F.count_if(F.col("vec").isNull()).alias("no_embedding"), F.count_if(F.col("ner_entities").isNull()).alias("no_entities"), F.count_if(missing).alias("links_missing"))


@query("P14_word_family", "SELECT token, count(*) AS n FROM tokens WHERE starts_with(token, 'ver') GROUP BY 1", "tokens")
def p14(spark, d):
    from rostrum.functions.text import tokens

    rows = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return rows.where(F.startswith("token", F.lit("ver"))).groupBy("token").agg(F.count("*").alias("n"))


@query("P15_valid_names", "WITH n AS (SELECT o_orderkey, concat(c_name, CASE o_orderkey % 4 WHEN 0 THEN ' ve ' WHEN 1 THEN ' ile ' ELSE ' x ' END, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE concat(o_orderpriority, ' of a much longer name') END) AS name FROM orders JOIN customer ON c_custkey = o_custkey), k AS (SELECT *, length(name) > 45 AS long, list_has_any(string_split(lower(name), ' '), ['ve', 'ile']) AS conj FROM n) SELECT o_orderkey, NOT long AND NOT conj AS valid, concat_ws(', ', CASE WHEN long THEN 'too long' END, CASE WHEN conj THEN 'conjunction' END) AS problems FROM k")
def p15(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    word = F.when(F.col("o_orderkey") % 4 == 0, " ve ").when(F.col("o_orderkey") % 4 == 1, " ile ").otherwise(" x ")
    name = F.concat("c_name", word, F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" of a much longer name"))))
    rows = rows.withColumn("name", name)
    return rows.select("o_orderkey", names.is_valid_name(F.col("name")).alias("valid"), F.array_join(names.name_problems(F.col("name")), ", ").alias("problems"))


@query("P16_excluded_topics", "SELECT topic_id, count(*) AS n FROM speeches WHERE topic_id NOT IN (-1, 1, 3, 5) GROUP BY 1", "speeches")
def p16(spark, d):
    from rostrum.sources.schema import analysed_topic

    return speeches(spark, d).where(analysed_topic(F.col("topic_id"))).groupBy("topic_id").agg(F.count("*").alias("n"))


@query("P17_confident_entities", "SELECT speech_key, count(*) FILTER (confidence >= 0.95) AS sure, bool_or(entity_group = 'LOC') AS has_place FROM entities GROUP BY 1", "entities")
def p17(spark, d):
    sure = F.size(F.filter("ner_entities", lambda e: e["confidence"] >= 0.95)).cast("long")
    return nested_entities(spark, d).select("speech_key", sure.alias("sure"), F.exists("ner_entities", lambda e: e["entity_group"] == "LOC").alias("has_place"))


@query("S13_conform")
def s13(spark, d):
    from rostrum.sources.schema import conform

    return conform(speeches(spark, d))


#: Fields of the joined table and their types.
REPORT = {
    "speech_key": "bigint", "ner_entities": "array<struct<entity:string,entity_group:string,frequency:int,wikipedia_url:string,confidence:double>>", "ner_entities[].entity": "string",
    "ner_entities[].entity_group": "string", "ner_entities[].frequency": "int", "ner_entities[].wikipedia_url": "string", "ner_entities[].confidence": "double", "id": "string", "session_id": "string",
    "term": "int", "year": "int", "speech_giver": "string", "province": "string", "political_party_at_time": "string", "topic_id": "int", "topic_label": "string", "session_date": "date",
}
REPORT_SQL = (
    "WITH j AS (SELECT s.* FROM speeches s WHERE EXISTS (SELECT 1 FROM entities e WHERE e.speech_key = s.speech_key)), f AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in REPORT.items())
    + ") AS f(field, type)), c AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS field, count({'id' if k == 'ner_entities' else k}) AS present FROM j" for k in REPORT if "[]" not in k)
    + ") SELECT f.field, f.type, c.present FROM f LEFT JOIN c ON c.field = f.field"
)


@query("S14_schema_report", REPORT_SQL, "speeches", "entities")
def s14(spark, d):
    return files.schema_rows(nested_entities(spark, d).join(speeches(spark, d), "speech_key"))


@query("S14_richest_sample", "SELECT *, CAST(CASE WHEN topic_id IS NULL THEN 0 ELSE 8 END + CASE WHEN content IS NULL THEN 0 ELSE 4 END + CASE WHEN political_party_at_time IS NULL THEN 0 ELSE 2 END AS INT) AS richness FROM speeches ORDER BY richness DESC, id LIMIT 1", "speeches")
def s14_sample(spark, d):
    return files.richest(speeches(spark, d, content=True), [["topic_id"], ["content"], ["political_party_at_time"]], "id")


@query("S3_entities_flat", "SELECT entity_group, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS mentions FROM entities GROUP BY 1", "entities")
def s3(spark, d):
    return entities(spark, d).groupBy("entity_group").agg(F.count("*").alias("n"), F.sum("frequency").alias("mentions"))
