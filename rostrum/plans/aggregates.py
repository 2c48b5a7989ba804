"""Joins, aggregates and reviews over speeches (J and A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import names
from rostrum.functions import text as texts
from rostrum.operators import cluster, enrich, facets, review, search, topics
from rostrum.plans.registry import query, ratio_sql
from rostrum.sources.fixtures import calendar, entities, keywords, members, nested_entities, speeches, table

OK = "topic_id NOT IN (-1, 1, 3, 5)"
SUMMARY_SQL = "summary AS (SELECT speech_giver, topic_id, topic_label, count(*) AS speech_count, list_sort(list(DISTINCT term)) AS terms, list_sort(list(DISTINCT year)) AS years FROM speeches WHERE topic_label IS NOT NULL AND topic_id <> -1 GROUP BY 1, 2, 3)"
LABEL_SQL = "row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, topic_label)"


def party_topics_sql(keys: str, n: int) -> str:
    return f"""WITH f AS (SELECT * FROM speeches WHERE {OK}), g AS (SELECT {keys}, topic_id, count(*) AS cnt FROM f GROUP BY {keys}, topic_id),
l AS (SELECT {keys}, topic_id, topic_label, row_number() OVER (PARTITION BY {keys}, topic_id ORDER BY count(*) DESC, topic_label) AS r FROM f GROUP BY {keys}, topic_id, topic_label),
w AS (SELECT *, round(cnt * 100e0 / sum(cnt) OVER (PARTITION BY {keys}), 1) AS pct, row_number() OVER (PARTITION BY {keys} ORDER BY cnt DESC, topic_id) AS rk FROM g)
SELECT {keys}, topic_id, l.topic_label, cnt, CAST(pct AS DOUBLE) AS pct FROM w JOIN (SELECT * FROM l WHERE r = 1) l USING ({keys}, topic_id) WHERE rk <= {n}"""


@query("J1_party_at_time", "SELECT s.id, m.party FROM speeches s LEFT JOIN mps m ON m.term = s.term AND m.mp_name = s.speech_giver", "speeches", "mps")
def j1(spark, d):
    return enrich.exact_party(speeches(spark, d), members(spark, d)).select("id", "party")


J2_SQL = f"""WITH RECURSIVE m AS (SELECT CAST(n_regionkey + 17 AS INT) AS term, n_name AS mp_name FROM nation),
s AS (SELECT term, concat(left(mp_name, length(mp_name) - 2), right(mp_name, 1)) AS speech_giver FROM m),
open AS (SELECT s.term, s.speech_giver, m.mp_name FROM s JOIN m USING (term) WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.term = s.term AND e.mp_name = s.speech_giver)),
{ratio_sql("SELECT DISTINCT mp_name AS a, speech_giver AS b FROM open")},
best AS (SELECT term, speech_giver, arg_max(mp_name, (similarity, mp_name)) AS party FROM open JOIN ratio ON a = mp_name AND b = speech_giver WHERE similarity >= 0.85e0 GROUP BY 1, 2)
SELECT s.term, s.speech_giver, coalesce(m.mp_name, best.party) AS party FROM s LEFT JOIN m ON m.term = s.term AND m.mp_name = s.speech_giver LEFT JOIN best ON best.term = s.term AND best.speech_giver = s.speech_giver"""


@query("J2_fuzzy_party", J2_SQL)
def j2(spark, d):
    """Every name lost its last but one letter, as misread names do."""
    misread = F.concat(F.expr("left(speech_giver, length(speech_giver) - 2)"), F.right("speech_giver", F.lit(1)))
    named = table(spark, d, "nation").select(F.col("n_name").alias("speech_giver"), (F.col("n_regionkey") + 17).alias("term"))
    return enrich.fuzzy_party(named.withColumn("speech_giver", misread), named.select("term", F.col("speech_giver").alias("mp_name"), F.col("speech_giver").alias("party")))


J2_NAMES_SQL = f"""WITH RECURSIVE m AS (SELECT CAST(min(p_partkey % 40) AS INT) AS term, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS mp_name FROM part GROUP BY 2),
s AS (SELECT term, concat(left(mp_name, 3), right(mp_name, length(mp_name) - 4)) AS speech_giver FROM m),
open AS (SELECT DISTINCT s.term, s.speech_giver, m.mp_name FROM s JOIN m USING (term) WHERE NOT EXISTS (SELECT 1 FROM m e WHERE e.term = s.term AND e.mp_name = s.speech_giver)),
{ratio_sql("SELECT DISTINCT mp_name AS a, speech_giver AS b FROM open")},
best AS (SELECT term, speech_giver, arg_max(mp_name, (similarity, mp_name)) AS party FROM open JOIN ratio ON a = mp_name AND b = speech_giver WHERE similarity >= 0.85e0 GROUP BY 1, 2)
SELECT s.term, s.speech_giver, coalesce(m.mp_name, best.party) AS party FROM s LEFT JOIN m ON m.term = s.term AND m.mp_name = s.speech_giver LEFT JOIN best ON best.term = s.term AND best.speech_giver = s.speech_giver"""


@query("J2_fuzzy_names", J2_NAMES_SQL)
def j2_names(spark, d):
    """Part names as members of forty terms; every speaker's name lost its fourth letter."""
    named = table(spark, d, "part").groupBy(names.first_words(F.col("p_name"), 2).alias("mp_name")).agg(F.min(F.col("p_partkey") % 40).cast("int").alias("term"))
    said = named.select("term", F.expr("concat(left(mp_name, 3), right(mp_name, length(mp_name) - 4))").alias("speech_giver"))
    return enrich.fuzzy_party(said, named.select("term", "mp_name", F.col("mp_name").alias("party")))


@query("J3_close_names", "WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a.n AS name_a, b.n AS name_b FROM n a JOIN n b ON a.n < b.n AND levenshtein(a.n, b.n) <= 3")
def j3(spark, d):
    return enrich.close_names(table(spark, d, "part"), "p_name", 3)


SIMILAR_SQL = f"""n AS (SELECT DISTINCT p_name AS n, array_to_string(string_split(p_name, ' ')[1:3], ' ') AS s FROM part),
{ratio_sql("SELECT DISTINCT y.s AS a, x.s AS b FROM n x JOIN n y ON x.n <> y.n")},
similar_names AS (SELECT x.n AS name_a, y.n AS name_b, similarity FROM n x JOIN n y ON x.n <> y.n JOIN ratio ON a = y.s AND b = x.s WHERE similarity >= 0.8e0)"""


@query("J3_similar_names", f"WITH RECURSIVE {SIMILAR_SQL} SELECT name_a, name_b, similarity FROM similar_names")
def j3_similar(spark, d):
    return enrich.similar_names(table(spark, d, "part"), "p_name", 0.8)


@query("J3_ranked_names", f"WITH RECURSIVE {SIMILAR_SQL}, k AS (SELECT p_name AS name_b, bool_or(p_partkey % 3 <> 0 AND coalesce(p_type, '') <> '') AS has_party FROM part GROUP BY 1) SELECT name_a, name_b, CAST(row_number() OVER (PARTITION BY name_a ORDER BY similarity DESC, has_party DESC, name_b) AS INT) AS rank, has_party FROM similar_names JOIN k USING (name_b)")
def j3_ranked(spark, d):
    """Every third name has no type, as names without a party."""
    rows = table(spark, d, "part").select("p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("party"))
    return enrich.ranked_matches(enrich.similar_names(rows, "p_name", 0.8), rows, "p_name").select("name_a", "name_b", "rank", "has_party")


@query("J4_session_dates", "SELECT s.id, x.day FROM speeches s LEFT JOIN (SELECT session_id, min(session_date) AS day FROM speeches WHERE year <> 3 GROUP BY 1) x ON x.session_id = s.session_id", "speeches")
def j4(spark, d):
    rows = speeches(spark, d)
    days = rows.where("year <> 3").groupBy("session_id").agg(F.min("session_date").alias("day"))
    return rows.join(days, "session_id", "left").select("id", "day")


@query("J5_new_only", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def j5(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("J5_update_mode", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def j5_update(spark, d):
    return enrich.plan_ingest(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


CENTRE_SQL = """c0 AS (SELECT label AS topic_id, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) WHERE label NOT IN (-1, 1) GROUP BY 1, 2),
centre AS (SELECT topic_id, list(x ORDER BY i) AS c FROM c0 GROUP BY 1),
sims AS (SELECT e.vec_id, e.label, t.topic_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), t.c) AS sim FROM embeddings e CROSS JOIN centre t)"""
NEAREST_SQL = "near AS (SELECT vec_id, arg_max(topic_id, (round(sim, 9), -topic_id)) AS topic_id, max(sim) AS sim FROM sims GROUP BY 1)"


def vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("label", "topic_id")


@query("J7_nearest_topic", f"WITH {CENTRE_SQL}, {NEAREST_SQL} SELECT vec_id, CASE WHEN sim >= 0.25 THEN topic_id END AS topic_id, round(sim, 6) AS sim FROM near")
def j7(spark, d):
    found = topics.nearest(vectors(spark, d), topics.centroids(vectors(spark, d)), "vec_id", threshold=0.25)
    return found.select("vec_id", "topic_id", F.round("sim", 6).alias("sim"))


@query("J8_entity_links", "WITH l AS (SELECT entity, concat('https://example.org/l/', entity) AS link FROM (SELECT DISTINCT entity FROM entities WHERE frequency > 1)) SELECT e.speech_key, count(*) AS entities, count(coalesce(nullif(e.wikipedia_url, ''), l.link)) AS linked FROM entities e LEFT JOIN l ON l.entity = e.entity GROUP BY 1", "entities")
def j8(spark, d):
    links = entities(spark, d).where("frequency > 1").select("entity", F.concat(F.lit("https://example.org/l/"), "entity").alias("link")).distinct()
    done = enrich.attach_links(nested_entities(spark, d), links)
    linked = F.size(F.filter("ner_entities", lambda e: e["wikipedia_url"].isNotNull())).cast("long")
    return done.select("speech_key", F.size("ner_entities").cast("long").alias("entities"), linked.alias("linked"))


@query("J9_label_overlay", "WITH a AS (SELECT topic_id, min(topic_label) AS old FROM speeches WHERE topic_id IS NOT NULL GROUP BY 1), b AS (SELECT label AS topic_id, concat('new ', label) AS fresh FROM embeddings GROUP BY 1, 2) SELECT coalesce(a.topic_id, b.topic_id) AS topic_id, coalesce(fresh, old) AS label FROM a FULL JOIN b ON a.topic_id = b.topic_id", "speeches")
def j9(spark, d):
    old = speeches(spark, d).where("topic_id is not null").groupBy("topic_id").agg(F.min("topic_label").alias("label"))
    fresh = vectors(spark, d).select("topic_id", F.concat(F.lit("new "), "topic_id").alias("label")).distinct()
    return enrich.upsert(old, fresh, "topic_id")


@query("J10_party_by_term_list", f"WITH {SUMMARY_SQL} SELECT s.speech_giver, m.party, m.term, s.topic_id, s.topic_label, s.speech_count FROM summary s JOIN mps m ON m.mp_name = s.speech_giver AND list_contains(s.terms, m.term)", "speeches", "mps")
def j10(spark, d):
    rows = facets.summary(speeches(spark, d))
    joined = rows.join(members(spark, d), (F.col("mp_name") == F.col("speech_giver")) & F.array_contains("terms", F.col("term")))
    return joined.select("speech_giver", "party", "term", "topic_id", "topic_label", "speech_count")


@query("J11_calendar", "SELECT s.id, c.year_from, c.year_to FROM speeches s JOIN calendar c ON c.term = s.term AND c.year = s.year", "speeches", "calendar")
def j11(spark, d):
    return speeches(spark, d).join(F.broadcast(calendar(spark)), ["term", "year"]).select("id", "year_from", "year_to")


@query("J12_topic_vectors", "SELECT s.topic_id, count(*) AS n, round(avg(CAST(e.embedding[1] AS DOUBLE)), 6) AS head FROM speeches s JOIN embeddings e ON e.vec_id = s.speech_key GROUP BY 1", "speeches")
def j12(spark, d):
    rows = speeches(spark, d).join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("speech_key"))
    return rows.groupBy("topic_id").agg(F.count("*").alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 6).alias("head"))


@query("A1_total", "SELECT count(*) AS n FROM speeches", "speeches")
def a1(spark, d):
    return speeches(spark, d).agg(F.count("*").alias("n"))


@query("A2_by_name_token", r"SELECT c_name AS name, (SELECT count(*) FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['der', 'nation'])) AS any_token, count(*) AS exact FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a2(spark, d):
    any_ = table(spark, d, "documents").where(search.match_any_token(F.col("text"), "Der Nation")).agg(F.count("*").alias("any_token"))
    exact = speeches(spark, d).groupBy(F.col("speech_giver").alias("name")).agg(F.count("*").alias("exact"))
    return exact.crossJoin(F.broadcast(any_))


@query("A3_activity", "WITH g AS (SELECT s.speech_giver, c.year_from AS calendar_year, s.term, s.year, count(*) AS n FROM speeches s JOIN calendar c ON c.term = s.term AND c.year = s.year GROUP BY ALL) SELECT speech_giver, calendar_year, CAST(sum(n) AS BIGINT) AS speeches, min(term * 100 + year) // 100 AS term, min(term * 100 + year) % 100 AS year FROM g GROUP BY 1, 2", "speeches", "calendar")
def a3(spark, d):
    return facets.activity(speeches(spark, d), calendar(spark))


@query("A4_topic_statistics", "WITH f AS (SELECT * FROM speeches WHERE topic_id NOT IN (-1, 1)), l AS (SELECT topic_id, topic_label, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, topic_label) AS r FROM f WHERE topic_label IS NOT NULL GROUP BY 1, 2) SELECT f.topic_id, coalesce(min(l.topic_label), concat('Topic ', f.topic_id)) AS topic_label, count(*) AS speech_count FROM f LEFT JOIN l ON l.topic_id = f.topic_id AND l.r = 1 GROUP BY f.topic_id", "speeches")
def a4(spark, d):
    return facets.topic_statistics(speeches(spark, d))


@query("A5_member_topics", party_topics_sql("speech_giver", 4), "speeches")
def a5(spark, d):
    return facets.top_topics(speeches(spark, d), ["speech_giver"], 4)


@query("A6_member_party_topics", party_topics_sql("speech_giver, political_party_at_time", 10).replace("WHERE topic_id NOT", "WHERE political_party_at_time IS NOT NULL AND topic_id NOT"), "speeches")
def a6(spark, d):
    return facets.top_topics(speeches(spark, d).where("political_party_at_time is not null"), ["speech_giver", "political_party_at_time"], 10)


FACET_SQL = """WITH x AS (SELECT 'term' AS facet, CAST(term AS VARCHAR) AS value, CAST(term AS BIGINT) AS place FROM speeches {w} UNION ALL SELECT 'year', CAST(year AS VARCHAR), {year} FROM speeches {w} UNION ALL SELECT 'political_party_at_time', political_party_at_time, NULL FROM speeches {w}
UNION ALL SELECT 'topic_id', CAST(topic_id AS VARCHAR), NULL FROM speeches {w} UNION ALL SELECT '{who}', {who}, NULL FROM speeches {w}), g AS (SELECT facet, value, place, count(*) AS cnt FROM x WHERE value IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY place DESC NULLS LAST, cnt DESC, value) AS INT) AS rank FROM g) SELECT facet, value, cnt, rank FROM r WHERE rank <= CASE facet {limits} END"""


@query("A7_facets", FACET_SQL.format(w="", year="CAST(year AS BIGINT)", who="province", limits="WHEN 'term' THEN 50 WHEN 'year' THEN 10 WHEN 'political_party_at_time' THEN 50 WHEN 'topic_id' THEN 200 ELSE 100"), "speeches")
def a7(spark, d):
    return facets.facets(speeches(spark, d))


@query("A8_filters", FACET_SQL.format(w="WHERE NOT coalesce(topic_id IN (-1, 1), false)", year="CAST(year AS BIGINT)", who="speech_giver", limits="WHEN 'term' THEN 50 WHEN 'year' THEN 10 WHEN 'political_party_at_time' THEN 100 WHEN 'topic_id' THEN 200 ELSE 1000"), "speeches")
def a8(spark, d):
    limits = {"term": (50, "value"), "year": (10, "value"), "political_party_at_time": (100, "count"), "topic_id": (200, "count"), "speech_giver": (1000, "count")}
    return facets.facets(search.visible(speeches(spark, d)), limits)


@query("A9_index_stats", "SELECT count(*) AS speeches, count(DISTINCT session_id) AS sessions, count(DISTINCT speech_giver) AS members, count(DISTINCT CASE WHEN topic_id NOT IN (-1, 1) THEN topic_id END) AS topics, min(term) AS first_term, max(term) AS last_term, min(year) AS first_year, max(year) AS last_year, count(DISTINCT CASE WHEN term >= 17 THEN speech_giver END) AS recent_members FROM speeches", "speeches")
def a9(spark, d):
    return facets.index_stats(speeches(spark, d))


ENTITY_SQL = "WITH f AS ({f}), g AS (SELECT entity, count(*) AS mentions FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50), t AS (SELECT entity, entity_group, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, entity_group) AS r FROM f GROUP BY 1, 2) SELECT g.entity, mentions, t.entity_group FROM g JOIN t ON t.entity = g.entity AND t.r = 1"


@query("A10_top_entities", ENTITY_SQL.format(f="SELECT * FROM entities"), "entities")
def a10(spark, d):
    return facets.top_entities(nested_entities(spark, d))


@query("A10_top_entities_document", ENTITY_SQL.format(f="SELECT * FROM entities WHERE speech_key IN (SELECT speech_key FROM entities WHERE entity_group = 'LOC')"), "entities")
def a10_document(spark, d):
    return facets.top_entities(nested_entities(spark, d), "LOC", "document")


@query("A10_top_entities_entity", ENTITY_SQL.format(f="SELECT * FROM entities WHERE entity_group = 'LOC'"), "entities")
def a10_entity(spark, d):
    return facets.top_entities(nested_entities(spark, d), "LOC", "entity")


@query("A11_periods", "SELECT DISTINCT term, year FROM speeches", "speeches")
def a11(spark, d):
    return speeches(spark, d).select("term", "year").distinct().orderBy(F.col("term").desc(), F.col("year").desc())


TALKED_SQL = f"talked AS (SELECT term, year, topic_id AS talked_topic, cnt AS talked_count FROM (SELECT term, year, topic_id, count(*) AS cnt, row_number() OVER (PARTITION BY term, year ORDER BY count(*) DESC, topic_id) AS r FROM speeches WHERE {OK} GROUP BY 1, 2, 3) WHERE r = 1)"
ACTIVE_SQL = "active0 AS (SELECT term, year, speech_giver AS active_member, cnt AS active_count FROM (SELECT term, year, speech_giver, count(*) AS cnt, row_number() OVER (PARTITION BY term, year ORDER BY count(*) DESC, speech_giver) AS r FROM speeches GROUP BY 1, 2, 3) WHERE r = 1), active AS (SELECT a.term, a.year, active_member, active_count, p.province AS active_province FROM active0 a JOIN (SELECT term, year, speech_giver, province, row_number() OVER (PARTITION BY term, year, speech_giver ORDER BY count(*) DESC, province) AS r FROM speeches GROUP BY 1, 2, 3, 4) p ON p.term = a.term AND p.year = a.year AND p.speech_giver = a.active_member AND p.r = 1)"
SHINING_SQL = "shining AS (SELECT term, year, province AS shining_province, round(x, 1) AS shining_ratio FROM (SELECT *, row_number() OVER (PARTITION BY term, year ORDER BY x DESC, province) AS r FROM (SELECT term, year, province, CAST(count(*) AS DOUBLE) / count(DISTINCT speech_giver) AS x FROM speeches GROUP BY 1, 2, 3)) WHERE r = 1)"
NICHE_SQL = f"niche0 AS (SELECT term, year, topic_id AS niche_topic, cnt AS niche_count FROM (SELECT term, year, topic_id, count(*) AS cnt, row_number() OVER (PARTITION BY term, year ORDER BY count(*), topic_id) AS r FROM speeches WHERE {OK} GROUP BY 1, 2, 3) WHERE r = 1), niche AS (SELECT n.*, w.speech_giver AS niche_member FROM niche0 n JOIN (SELECT term, year, topic_id, speech_giver, row_number() OVER (PARTITION BY term, year, topic_id ORDER BY count(*) DESC, speech_giver) AS r FROM speeches GROUP BY 1, 2, 3, 4) w ON w.term = n.term AND w.year = n.year AND w.topic_id = n.niche_topic AND w.r = 1)"
DIVERSE_SQL = f"diverse AS (SELECT term, year, topic_id AS diverse_topic, m AS diverse_members, least(CAST(floor(m * 0.3) AS INT), 15) AS perspectives FROM (SELECT term, year, topic_id, count(DISTINCT speech_giver) AS m, row_number() OVER (PARTITION BY term, year ORDER BY count(DISTINCT speech_giver) DESC, topic_id) AS r FROM speeches WHERE {OK} GROUP BY 1, 2, 3) WHERE r = 1)"
DECLINE_SQL = f"pc AS (SELECT term, year, topic_id, count(*) AS n FROM speeches WHERE {OK} GROUP BY 1, 2, 3), pp AS (SELECT term, year, lag(term) OVER (ORDER BY term, year) AS bt, lag(year) OVER (ORDER BY term, year) AS b_y FROM (SELECT DISTINCT term, year FROM pc)), dd AS (SELECT pp.term, pp.year, b.topic_id, coalesce(c.n, 0) - b.n AS dr FROM pp JOIN pc b ON b.term = pp.bt AND b.year = pp.b_y LEFT JOIN pc c ON c.term = pp.term AND c.year = pp.year AND c.topic_id = b.topic_id), declining AS (SELECT term, year, topic_id AS declining_topic, dr AS declining_change FROM (SELECT *, row_number() OVER (PARTITION BY term, year ORDER BY dr, topic_id) AS r FROM dd) WHERE r = 1)"


@query("A12_most_talked", f"WITH {TALKED_SQL} SELECT * FROM talked", "speeches")
def a12(spark, d):
    return review.most_talked(speeches(spark, d)).drop("talked_name")


@query("A13_most_active", f"WITH {ACTIVE_SQL} SELECT * FROM active", "speeches")
def a13(spark, d):
    return review.most_active(speeches(spark, d))


@query("A14_shining_province", f"WITH {SHINING_SQL} SELECT * FROM shining", "speeches")
def a14(spark, d):
    return review.busiest_province(speeches(spark, d))


@query("A15_niche_topic", f"WITH {NICHE_SQL} SELECT * FROM niche", "speeches")
def a15(spark, d):
    return review.niche(speeches(spark, d))


@query("A16_most_diverse", f"WITH {DIVERSE_SQL} SELECT * FROM diverse", "speeches")
def a16(spark, d):
    return review.most_diverse(speeches(spark, d))


@query("A17_annual_review", f"WITH {TALKED_SQL}, {ACTIVE_SQL}, {SHINING_SQL}, {NICHE_SQL}, {DIVERSE_SQL}, {DECLINE_SQL} SELECT * FROM (SELECT DISTINCT term, year FROM speeches) LEFT JOIN talked USING (term, year) LEFT JOIN active USING (term, year) LEFT JOIN shining USING (term, year) LEFT JOIN niche USING (term, year) LEFT JOIN diverse USING (term, year) LEFT JOIN declining USING (term, year)", "speeches")
def a17(spark, d):
    return review.annual_review(speeches(spark, d)).drop("talked_name")


@query("A18_declining", f"WITH {DECLINE_SQL} SELECT * FROM declining", "speeches")
def a18(spark, d):
    return review.declining(speeches(spark, d))


@query("A19_summary", f"WITH {SUMMARY_SQL} SELECT speech_giver, topic_id, topic_label, speech_count, array_to_string(terms, ',') AS terms, array_to_string(years, ',') AS years FROM summary", "speeches")
def a19(spark, d):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return facets.summary(speeches(spark, d)).select("speech_giver", "topic_id", "topic_label", "speech_count", joined("terms"), joined("years"))


@query("A20_topic_details", f"WITH {SUMMARY_SQL}, m AS (SELECT topic_id, speech_giver, CAST(sum(speech_count) AS BIGINT) AS cnt FROM summary GROUP BY 1, 2), r AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY topic_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY topic_id ORDER BY cnt DESC, speech_giver) AS rank FROM m) SELECT r.topic_id, l.label, speech_giver, cnt, total, l.members, round(cnt * 100e0 / total, 1) AS pct FROM r JOIN (SELECT topic_id, min(topic_label) AS label, count(DISTINCT speech_giver) AS members FROM summary GROUP BY 1) l USING (topic_id) WHERE rank <= 10", "speeches")
def a20(spark, d):
    rows = facets.summary(speeches(spark, d))
    per = facets.shares(rows.groupBy("topic_id", "speech_giver").agg(F.sum("speech_count").alias("cnt")), ["topic_id"])
    whole = rows.groupBy("topic_id").agg(F.min("topic_label").alias("label"), F.count_distinct("speech_giver").alias("members"), F.sum("speech_count").alias("total"))
    top = facets.ranked(per, ["topic_id"], F.col("cnt").desc(), F.col("speech_giver")).where("rank <= 10").drop("rank")
    return top.join(whole, "topic_id")


@query("A21_topics_by_party", f"WITH {SUMMARY_SQL}, j AS (SELECT s.speech_giver, m.party, m.term, s.topic_id, s.topic_label, s.speech_count, row_number() OVER (PARTITION BY s.speech_giver, m.party, s.topic_id ORDER BY m.term DESC, s.topic_label DESC) AS r FROM summary s JOIN mps m ON m.mp_name = s.speech_giver AND list_contains(s.terms, m.term)) SELECT speech_giver, party, topic_id, term, topic_label, speech_count FROM j WHERE r = 1", "speeches", "mps")
def a21(spark, d):
    rows = facets.summary(speeches(spark, d))
    joined = rows.join(members(spark, d), (F.col("mp_name") == F.col("speech_giver")) & F.array_contains("terms", F.col("term")))
    last = facets.best(joined, ["speech_giver", "party", "topic_id"], F.col("term").desc(), F.col("topic_label").desc())
    return last.select("speech_giver", "party", "topic_id", "term", "topic_label", "speech_count")


@query("A22_topic_labels", "WITH k AS (SELECT s.topic_id, k.keyword, count(*) AS cnt FROM keywords k JOIN speeches s ON s.speech_key = k.speech_key WHERE s.topic_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY cnt DESC, keyword) AS r FROM k) SELECT topic_id, CASE WHEN topic_id = -1 THEN 'Outliers' ELSE string_agg(keyword, ', ' ORDER BY r) END AS label FROM r WHERE r <= 5 GROUP BY 1", "speeches", "keywords")
def a22(spark, d):
    rows = keywords(spark, d).join(speeches(spark, d).where("topic_id is not null").select("speech_key", "topic_id"), "speech_key")
    return topics.keyword_labels(rows)


PIVOT_SQL = "wide AS (SELECT mp_name AS speech_giver, " + ", ".join(f"coalesce(max(CASE WHEN term = {t} THEN party END), '') AS term{t}" for t in range(17, 24)) + " FROM mps GROUP BY 1)"


@query("A23_member_pivot", f"WITH {PIVOT_SQL} SELECT * FROM wide", "mps")
def a23(spark, d):
    return enrich.pivot_members(members(spark, d))


@query("A24_party_lists", "SELECT mp_name AS speech_giver, string_agg(concat(term, '.dönem ', party), '; ' ORDER BY term) AS parties, string_agg(CAST(term AS VARCHAR), ',' ORDER BY term) AS terms FROM mps GROUP BY 1", "mps")
def a24(spark, d):
    long = enrich.unpivot_members(enrich.pivot_members(members(spark, d)))
    return long.select("speech_giver", F.array_join("parties", "; ").alias("parties"), F.array_join(F.transform("terms", lambda x: x.cast("string")), ",").alias("terms"))


@query("A25_merge_names", "WITH r AS (SELECT o_orderkey AS pos, concat(n_name, '''ın') AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS party, year(o_orderdate) - 1978 AS term FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) SELECT split_part(name, '''', 1) AS norm, arg_min(party, pos) FILTER (party <> '') AS party, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms, count(*) AS merged FROM r GROUP BY 1")
def a25(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    named = rows.select(F.col("o_orderkey").alias("pos"), F.concat("n_name", F.lit("'ın")).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("party"), F.array(F.year("o_orderdate") - 1978).alias("terms"))
    merged = enrich.merge_names(named)
    return merged.select("norm", "party", F.array_join(F.transform("terms", lambda x: x.cast("string")), ",").alias("terms"), "merged")


A26_SQL = f"""WITH RECURSIVE {SIMILAR_SQL}, reach AS (SELECT name_a AS name, name_a AS other FROM similar_names UNION SELECT name, name_b FROM reach JOIN similar_names ON name_a = other),
root AS (SELECT name, min(other) AS root FROM reach GROUP BY 1),
r AS (SELECT p_name AS name, min(p_type) AS party, count(DISTINCT p_size) AS n FROM part GROUP BY 1),
g AS (SELECT root, r.*, CASE WHEN coalesce(party, '') <> '' THEN 100 ELSE 0 END + n * 10 - length(name) AS score FROM r JOIN root USING (name)),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, name) AS place FROM g),
t AS (SELECT root, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS terms FROM root JOIN part ON p_name = name GROUP BY 1)
SELECT root, arg_min(name, place) AS canonical, arg_min(party, place) FILTER (coalesce(party, '') <> '') AS party, count(*) AS names, any_value(terms) AS terms FROM o JOIN t USING (root) GROUP BY root"""


@query("A26_canonical_names", A26_SQL)
def a26(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("party"), F.array_sort(F.collect_set("p_size")).alias("terms"))
    pairs = enrich.similar_names(rows, "name", 0.8).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    found = enrich.canonical_names(rows, cluster.connected_components(pairs).toDF("name", "root"))
    return found.withColumn("terms", F.array_join(F.transform("terms", lambda x: x.cast("string")), ","))


@query("A27_centroids", f"WITH {CENTRE_SQL} SELECT topic_id, CAST(i AS INT) AS i, round(x, 9) AS x FROM c0")
def a27(spark, d):
    return topics.centroids(vectors(spark, d)).select("topic_id", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 9))


@query("A28_largest_topics", "WITH c AS (SELECT term, topic_id, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, topic_id) AS r FROM speeches WHERE topic_id >= 0 GROUP BY 1, 2) SELECT s.id, CASE WHEN c.r <= 3 THEN s.topic_id ELSE -1 END AS topic_id FROM speeches s LEFT JOIN c ON c.term = s.term AND c.topic_id = s.topic_id", "speeches")
def a28(spark, d):
    return cluster.largest(speeches(spark, d).select("id", "term", "topic_id"), ["term"], "topic_id", 3).select("id", "topic_id")


@query("A29_cluster_guide", "SELECT topic_id, count(*) AS contexts, count(DISTINCT term * 100 + year) AS periods, array_to_string(list_sort(list(DISTINCT term * 100 + year)), ', ') AS span FROM speeches GROUP BY 1", "speeches")
def a29(spark, d):
    key = F.col("term") * 100 + F.col("year")
    rows = speeches(spark, d).groupBy("topic_id").agg(F.count("*").alias("contexts"), F.array_sort(F.collect_set(key)).alias("p"))
    return rows.select("topic_id", "contexts", F.size("p").cast("long").alias("periods"), F.array_join(F.transform("p", lambda x: x.cast("string")), ", ").alias("span"))


@query("A30_link_coverage", "SELECT s.term, count(DISTINCT e.speech_key) AS docs, count(DISTINCT CASE WHEN e.wikipedia_url <> '' THEN e.speech_key END) AS linked_docs, count(*) AS entities, count(*) FILTER (e.wikipedia_url <> '') AS linked, round(count(*) FILTER (e.wikipedia_url <> '') * 100e0 / count(*), 1) AS pct FROM entities e JOIN speeches s ON s.speech_key = e.speech_key GROUP BY 1", "entities", "speeches")
def a30(spark, d):
    links = F.size(F.filter("ner_entities", lambda e: e["wikipedia_url"] != "")).alias("links")
    rows = nested_entities(spark, d).select("speech_key", F.size("ner_entities").alias("n"), links).join(speeches(spark, d).select("speech_key", "term"), "speech_key")
    sums = rows.groupBy("term").agg(F.count("*").alias("docs"), F.count_if(F.col("links") > 0).alias("linked_docs"), F.sum("n").alias("entities"), F.sum("links").alias("linked"))
    return sums.withColumn("pct", F.round(F.col("linked") * 100.0 / F.col("entities"), 1))


@query("A31_field_coverage", "SELECT count(topic_id) * 1e0 / count(*) AS with_topic, count(*) FILTER (topic_id IS NOT NULL AND political_party_at_time IS NULL) * 1e0 / count(*) AS topic_without_party, count(*) FILTER (topic_id IS NULL) AS to_analyse FROM speeches", "speeches")
def a31(spark, d):
    n, has = F.count("*"), F.col("topic_id").isNotNull()
    return speeches(spark, d).agg((F.count("topic_id") / n).alias("with_topic"), (F.count_if(has & F.col("political_party_at_time").isNull()) / n).alias("topic_without_party"), F.count_if(~has).alias("to_analyse"))


@query("A32_keyword_quality", "WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'ERROR: none' ELSE replace(o_orderpriority, ' ', ', ') END AS k FROM orders) SELECT CASE WHEN starts_with(k, 'ERROR') THEN 0 ELSE len(string_split(k, ',')) END AS keywords, count(*) AS n, count(*) FILTER (starts_with(k, 'ERROR')) AS errors FROM g GROUP BY 1")
def a32(spark, d):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "ERROR: none").otherwise(F.replace("o_orderpriority", F.lit(" "), F.lit(", ")))
    rows = table(spark, d, "orders").select(raw.alias("k")).withColumn("bad", F.startswith("k", F.lit("ERROR")))
    return rows.groupBy(F.when(F.col("bad"), F.lit(0)).otherwise(F.size(texts.keyword_list(F.col("k")))).cast("long").alias("keywords")).agg(F.count("*").alias("n"), F.count_if("bad").alias("errors"))


@query("A33_engagement", f"WITH g AS (SELECT speech_giver, topic_id, count(*) AS cnt FROM speeches WHERE {OK} GROUP BY 1, 2) SELECT speech_giver, topic_id, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY speech_giver) AS ratio, 1 - CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY speech_giver) AS distance, sum(cnt) OVER (PARTITION BY topic_id) * 1e2 / (SELECT sum(cnt) FROM g) AS topic_share FROM g", "speeches")
def a33(spark, d):
    from pyspark.sql import Window as W

    from rostrum.sources.schema import analysed_topic

    counts = speeches(spark, d).where(analysed_topic(F.col("topic_id"))).groupBy("speech_giver", "topic_id").agg(F.count("*").alias("cnt"))
    ratio = F.col("cnt") / F.sum("cnt").over(W.partitionBy("speech_giver"))
    by_topic = counts.groupBy("topic_id").agg(F.sum("cnt").alias("t"))
    share = by_topic.crossJoin(F.broadcast(by_topic.agg(F.sum("t").alias("total")))).select("topic_id", (F.col("t") * 100.0 / F.col("total")).alias("topic_share"))
    return counts.select("speech_giver", "topic_id", ratio.alias("ratio"), (1 - ratio).alias("distance")).join(share, "topic_id")


@query("A34_stop_vocabulary", "SELECT w FROM (SELECT political_party_at_time AS w FROM speeches WHERE political_party_at_time IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) UNION SELECT w FROM (SELECT speech_giver AS w FROM speeches GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100) UNION SELECT unnest([" + ", ".join(f"'{w}'" for w in texts.INSTITUTIONS) + "])", "speeches")
def a34(spark, d):
    rows = speeches(spark, d)
    top = lambda c, n: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(n).select(names.party_without_term(F.col("w")).alias("w"))
    fixed = spark.createDataFrame([(w,) for w in texts.INSTITUTIONS], "w string")
    return top("political_party_at_time", 50).union(top("speech_giver", 100)).union(fixed).distinct()


@query("A35_entity_counts", "SELECT l_orderkey AS speech_key, l_returnflag AS word, CAST(count(*) AS BIGINT) AS frequency, arg_min(l_linestatus, (l_linenumber, l_partkey, l_linestatus, l_tax)) AS entity_group, arg_min(l_tax, (l_linenumber, l_partkey, l_linestatus, l_tax)) AS confidence FROM lineitem GROUP BY 1, 2")
def a35(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_linestatus", "l_tax")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("speech_key"), F.col("l_returnflag").alias("word")).agg(F.count("*").alias("frequency"), F.min_by("l_linestatus", order).alias("entity_group"), F.min_by("l_tax", order).alias("confidence"))


@query("A36_cluster_quality", "WITH s AS (SELECT topic_id AS c, count(*) AS n FROM speeches WHERE topic_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (c >= 0) AS clusters, CAST(sum(n) FILTER (c < 0) AS BIGINT) AS outliers, round(sum(n) FILTER (c < 0) * 100e0 / sum(n), 1) AS outlier_pct, round(avg(n) FILTER (c >= 0), 1) AS avg_size, min(n) FILTER (c >= 0) AS min_size, max(n) FILTER (c >= 0) AS max_size FROM s", "speeches")
def a36(spark, d):
    return cluster.quality(speeches(spark, d).where("topic_id is not null").select(F.col("topic_id").alias("cluster")))


@query("A37_max_topic", "SELECT coalesce(max(topic_id), 0) AS top FROM speeches", "speeches")
def a37(spark, d):
    return speeches(spark, d).agg(F.coalesce(F.max("topic_id"), F.lit(0)).alias("top"))


@query("A38_frequent_members", "SELECT speech_giver, count(*) AS n FROM speeches GROUP BY 1 HAVING count(*) >= 12", "speeches")
def a38(spark, d):
    return speeches(spark, d).groupBy("speech_giver").agg(F.count("*").alias("n")).where("n >= 12")


@query("A39_histogram", "WITH g AS (SELECT year(session_date) AS y, count(*) AS n FROM speeches WHERE year(session_date) <> 1998 GROUP BY 1) SELECT CAST(r.y AS INT) AS calendar_year, coalesce(g.n, 0) AS speeches FROM (SELECT unnest(range((SELECT min(y) FROM g), (SELECT max(y) FROM g) + 1)) AS y) r LEFT JOIN g ON g.y = r.y", "speeches")
def a39(spark, d):
    return facets.histogram(speeches(spark, d).where("year(session_date) <> 1998"))


@query("A40_topic_trend", "SELECT topic_id, term * 100 + year AS period, count(*) AS n FROM speeches WHERE topic_id IS NOT NULL GROUP BY 1, 2", "speeches")
def a40(spark, d):
    return speeches(spark, d).where("topic_id is not null").groupBy("topic_id", (F.col("term") * 100 + F.col("year")).alias("period")).agg(F.count("*").alias("n"))


@query("A41_modal_period", "SELECT speech_giver, term, year FROM (SELECT speech_giver, term, year, row_number() OVER (PARTITION BY speech_giver ORDER BY count(*) DESC, term, year) AS r FROM speeches GROUP BY 1, 2, 3) WHERE r = 1", "speeches")
def a41(spark, d):
    counts = speeches(spark, d).groupBy("speech_giver", "term", "year").agg(F.count("*").alias("n"))
    return facets.best(counts, ["speech_giver"], F.col("n").desc(), F.col("term"), F.col("year")).drop("n")


@query("A42_date_statistics", "WITH r AS (SELECT o_orderpriority AS dir, try_strptime(concat(o_custkey % 40, '.', o_orderkey % 15, '.', year(o_orderdate)), '%d.%m.%Y') AS x FROM orders) SELECT dir, count(*) AS files, count(x) AS found, round(count(x) * 100e0 / count(*), 1) AS rate FROM r GROUP BY ROLLUP (dir)")
def a42(spark, d):
    from rostrum.functions import dates
    from rostrum.operators import extract

    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    raw = F.concat(two(F.col("o_custkey") % 40), F.lit("."), two(F.col("o_orderkey") % 15), F.lit("."), F.year("o_orderdate"))
    return extract.date_statistics(table(spark, d, "orders").select(F.col("o_orderpriority").alias("dir"), dates.parsed(raw).alias("session_date")))


@query("A43_member_profile", f"WITH t AS (SELECT speech_giver, topic_id, topic_label, row_number() OVER (PARTITION BY speech_giver ORDER BY n DESC, topic_id) AS r FROM (SELECT speech_giver, topic_id, count(*) AS n, mode(topic_label ORDER BY topic_label) AS topic_label FROM speeches WHERE {OK} GROUP BY 1, 2)), p AS (SELECT mp_name, string_agg(DISTINCT party, ', ' ORDER BY party) AS parties, count(DISTINCT term) AS terms FROM mps GROUP BY 1), s AS (SELECT speech_giver, count(*) AS speeches FROM speeches GROUP BY 1) SELECT substr(md5(s.speech_giver), 1, 8) AS member_id, s.speech_giver, s.speeches, p.terms, t.topic_id AS top_topic, CASE WHEN t.topic_id IS NULL THEN concat('Member of ', p.parties, ' with parliamentary activity.') END AS silent_stance FROM s JOIN p ON p.mp_name = s.speech_giver LEFT JOIN t ON t.speech_giver = s.speech_giver AND t.r = 1", "speeches", "mps")
def a43(spark, d):
    rows = speeches(spark, d)
    top = facets.top_topics(rows, ["speech_giver"], 4).groupBy("speech_giver").agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "topic_id", "topic_label"))).alias("topics"))
    served = members(spark, d).groupBy(F.col("mp_name").alias("speech_giver")).agg(F.array_sort(F.collect_list(F.struct("term", "party"))).alias("m"))
    joined = rows.groupBy("speech_giver").agg(F.count("*").alias("speeches")).join(served, "speech_giver").join(top, "speech_giver", "left")
    parties = F.transform("m", lambda x: F.concat(x["term"], F.lit(".dönem "), x["party"]))
    said = names.stance(parties, F.col("topics.topic_label"))
    return joined.select(names.member_id(F.col("speech_giver")).alias("member_id"), "speech_giver", "speeches", F.size("m").cast("long").alias("terms"), F.col("topics")[0]["topic_id"].alias("top_topic"), F.when(F.col("topics").isNull(), said).alias("silent_stance"))


@query("A44_members_of_parties", "SELECT DISTINCT speech_giver FROM speeches WHERE political_party_at_time IN ('BUILDING', 'FURNITURE')", "speeches")
def a44(spark, d):
    return speeches(spark, d).where(F.col("political_party_at_time").isin("BUILDING", "FURNITURE")).select("speech_giver").distinct()


@query("A45_member_by_term", "WITH t AS (SELECT speech_giver FROM speeches GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) SELECT speech_giver, term, count(*) AS n FROM speeches JOIN t USING (speech_giver) GROUP BY 1, 2", "speeches")
def a45(spark, d):
    rows = speeches(spark, d)
    top = rows.groupBy("speech_giver").agg(F.count("*").alias("all")).orderBy(F.col("all").desc(), "speech_giver").limit(50)
    return rows.join(F.broadcast(top), "speech_giver").groupBy("speech_giver", "term").agg(F.count("*").alias("n"))
