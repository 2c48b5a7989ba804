"""Windows, sorting, set operations, functions and vector analytics (W, T, U, F, M)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import dates, names, text, vectors
from rostrum.operators import cluster, drift, enrich, extract, facets, order, search, topics
from rostrum.plans.aggregates import CENTRE_SQL, NEAREST_SQL
from rostrum.plans.aggregates import vectors as topic_vectors
from rostrum.plans.registry import query, ratio_sql
from rostrum.sources.fixtures import calendar, keywords, members, speeches, table
from rostrum.sources.store import fresh_path, stored

TOP_SQL = "SELECT term, province, count(*) AS cnt FROM speeches GROUP BY 1, 2"


def per_term(spark, d):
    return speeches(spark, d).groupBy("term", "province").agg(F.count("*").alias("cnt"))


@query("W1_top_per_group", f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY cnt DESC, province) AS r FROM ({TOP_SQL})) WHERE r <= 3", "speeches")
def w1(spark, d):
    return facets.ranked(per_term(spark, d), ["term"], F.col("cnt").desc(), F.col("province")).where("rank <= 3").drop("rank")


@query("W2_share_of_group", f"SELECT *, round(cnt * 100e0 / sum(cnt) OVER (PARTITION BY term), 1) AS pct FROM ({TOP_SQL})", "speeches")
def w2(spark, d):
    return facets.shares(per_term(spark, d), ["term"])


@query("W3_running_index", "SELECT id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY session_date, id) - 1 AS INT) AS n FROM speeches", "speeches")
def w3(spark, d):
    rows = speeches(spark, d).select("id", "topic_id", "session_date")
    return order.numbered(rows, ["session_date", "id"], ["topic_id"]).select("id", F.col("n").cast("int").alias("n"))


def timeline(spark, d):
    """A mean vector for each topic and calendar period of the speeches that vectors belong to."""
    rows = table(spark, d, "embeddings").join(speeches(spark, d).select("speech_key", "term", "year"), F.col("vec_id") == F.col("speech_key"))
    sizes = rows.groupBy("label", "term", "year").agg(F.count("*").alias("size"))
    return vectors.mean_vectors(rows, ["label", "term", "year"], "embedding", "centroid").join(sizes, ["label", "term", "year"])


TIMELINE_SQL = "tl0 AS (SELECT e.label, s.term, s.year, i, avg(x) AS x FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings) e JOIN speeches s ON s.speech_key = e.vec_id GROUP BY 1, 2, 3, 4), tl AS (SELECT label, term, year, list(x ORDER BY i) AS c FROM tl0 GROUP BY 1, 2, 3), sz AS (SELECT e.label, s.term, s.year, count(*) AS size FROM embeddings e JOIN speeches s ON s.speech_key = e.vec_id GROUP BY 1, 2, 3), t AS (SELECT tl.*, sz.size FROM tl JOIN sz USING (label, term, year)), f AS (SELECT *, first_value(c) OVER (PARTITION BY label ORDER BY term, year) AS c1, lag(c) OVER (PARTITION BY label ORDER BY term, year) AS c0, CAST(size AS DOUBLE) / sum(size) OVER (PARTITION BY term, year) AS z FROM t)"


@query("W4_drift", f"WITH {TIMELINE_SQL} SELECT label, term, year, size, round(1 - list_cosine_similarity(c, c1), 6) + 0 AS x, round(coalesce(1 - list_cosine_similarity(c, c0), 0), 6) AS y, round(z, 6) AS z FROM f", "speeches")
def w4(spark, d):
    moved = drift.drift(timeline(spark, d), ["label"], ["term", "year"], "centroid", "size")
    six = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return moved.select("label", "term", "year", "size", six("x"), six("y"), six("z"))


@query("W5_numbered_from_one", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), y AS (SELECT *, bool_and(l_linenumber = n) OVER (PARTITION BY l_orderkey ORDER BY n) AS ok FROM x) SELECT l_orderkey, count(*) AS accepted FROM y WHERE ok GROUP BY 1")
def w5(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return extract.numbered_from_one(rows, ["l_orderkey"], "l_linenumber", "o").groupBy("l_orderkey").agg(F.count("*").alias("accepted"))


PIECES_SQL = "p AS (SELECT user_id, event_id AS pos, value AS score, CASE WHEN value < 8 THEN concat('##', event_type) ELSE event_type END AS word, CASE WHEN event_id % 4 = 0 THEN 'LOC' ELSE 'PER' END AS g FROM events), q AS (SELECT *, lag(g) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM p), r AS (SELECT *, sum(CASE WHEN starts_with(word, '##') AND g = b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM q)"


@query("W6_word_pieces", f"WITH {PIECES_SQL} SELECT user_id, min(pos) AS pos, min(g) AS entity_group, string_agg(regexp_replace(word, '^##', ''), '' ORDER BY pos) AS word, round(list_reduce(list(score ORDER BY pos), lambda a, b: (a + b) / 2), 6) AS score FROM r GROUP BY user_id, island")
def w6(spark, d):
    word = F.when(F.col("value") < 8, F.concat(F.lit("##"), "event_type")).otherwise(F.col("event_type"))
    group = F.when(F.col("event_id") % 4 == 0, "LOC").otherwise("PER")
    pieces = table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), word.alias("word"), group.alias("entity_group"), F.col("value").alias("score"))
    return drift.merge_word_pieces(pieces, ["user_id"]).withColumn("score", F.round("score", 6))


@query("W7_contexts", r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), h AS (SELECT *, unnest(range(len(w))) AS pos FROM t) SELECT doc_id, CAST(pos AS INT) AS pos, w[pos + 1] AS token, array_to_string(w[greatest(pos + 1 - 10, 1):pos + 11], ' ') AS context FROM h WHERE starts_with(w[pos + 1], 'ver')")
def w7(spark, d):
    return drift.contexts(table(spark, d, "documents"), "doc_id", "text", "ver")


@query("W8_examples", "SELECT topic_id, term, id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, term ORDER BY session_date, id) AS r FROM speeches) WHERE r <= 10", "speeches")
def w8(spark, d):
    return facets.ranked(speeches(spark, d), ["topic_id", "term"], F.col("session_date"), F.col("id")).where("rank <= 10").select("topic_id", "term", "id")


@query("W9_last_wins", "SELECT mp_name, arg_max(party, term) AS party, max(term) AS term FROM mps GROUP BY 1", "mps")
def w9(spark, d):
    return members(spark, d).groupBy("mp_name").agg(F.max_by("party", "term").alias("party"), F.max("term").alias("term"))


@query("W10_renumber", "WITH l AS (SELECT vec_id, CASE WHEN label < 3 THEN -1 ELSE label * 10 END AS c FROM embeddings) SELECT vec_id, CASE WHEN c < 0 THEN -1 ELSE CAST((SELECT max(topic_id) FROM speeches) + dense_rank() OVER (ORDER BY CASE WHEN c < 0 THEN 1 ELSE 0 END, c) AS INT) END AS topic_id FROM l", "speeches")
def w10(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 3, -1).otherwise(F.col("label") * 10).alias("c"))
    top = speeches(spark, d).agg(F.max("topic_id").alias("top"))
    return topics.renumber(rows, "c", top).select("vec_id", "topic_id")


@query("W11_busy_periods", "SELECT speech_giver, term, count(*) AS n FROM speeches GROUP BY 1, 2 HAVING count(*) >= 4", "speeches")
def w11(spark, d):
    counted = speeches(spark, d).select("speech_giver", "term", F.count("*").over(W.partitionBy("speech_giver", "term")).alias("n"))
    return counted.where("n >= 4").distinct()


@query("T1_latest_first", "SELECT id, term, year, CAST(row_number() OVER (ORDER BY term DESC, year DESC, id) AS INT) AS place FROM speeches ORDER BY place LIMIT 100", "speeches")
def t1(spark, d):
    top = search.page(speeches(spark, d), [F.col("term").desc(), F.col("year").desc(), F.col("id")], 100)
    return top.select("id", "term", "year", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("term").desc(), F.col("year").desc(), "id")).alias("place"))


@query("T2_relevance", "WITH n AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT doc_id, count(*) AS dl FROM tokens GROUP BY 1)), l AS (SELECT doc_id, count(*) AS dl FROM tokens GROUP BY 1), tf AS (SELECT doc_id, token, count(*) AS tf FROM tokens WHERE token IN ('tion', 'der', 'le') GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n.n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))), 6) AS score FROM tf JOIN df USING (token) JOIN l USING (doc_id) CROSS JOIN n GROUP BY 1", "tokens")
def t2(spark, d):
    return text.bm25(table(spark, d, "documents"), "doc_id", "text", ["tion", "der", "le"]).withColumn("score", F.round("score", 6))


@query("T3_page", "SELECT id, CAST(ceil((SELECT count(*) FROM speeches) / 50e0) AS BIGINT) AS pages FROM speeches ORDER BY id LIMIT 50 OFFSET 100", "speeches")
def t3(spark, d):
    rows = speeches(spark, d)
    total = rows.agg(search.total_pages(F.count("*"), 50).alias("pages"))
    return search.page(rows, [F.col("id")], 50, 100).select("id").crossJoin(F.broadcast(total))


@query("T4_clamped_page", "WITH n AS (SELECT DISTINCT mp_name FROM mps) SELECT mp_name FROM n ORDER BY 1 LIMIT 64 OFFSET 64 * (CAST(ceil((SELECT count(*) FROM n) / 64e0) AS BIGINT) - 1)", "mps")
def t4(spark, d):
    return search.clamped_page(members(spark, d).select("mp_name").distinct(), [F.col("mp_name")], 10_000_000, 64)


@query("T5_largest_and_smallest", "(SELECT topic_id, count(*) AS n FROM speeches GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) UNION ALL (SELECT topic_id, count(*) FROM speeches GROUP BY 1 ORDER BY 2, 1 LIMIT 3)", "speeches")
def t5(spark, d):
    counts = speeches(spark, d).groupBy("topic_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("topic_id").asc_nulls_last()).limit(3).union(counts.orderBy("n", F.col("topic_id").asc_nulls_last()).limit(3))


@query("T6_sort_key", "SELECT DISTINCT term, year, term * 100 + year AS sort_key FROM speeches", "speeches")
def t6(spark, d):
    return speeches(spark, d).select("term", "year", dates.sort_key(F.col("term"), F.col("year")).alias("sort_key")).distinct()


@query("T7_sample", "SELECT id, topic_id FROM speeches ORDER BY md5(concat('42-', id)), id LIMIT 100", "speeches")
def t7(spark, d):
    """A sample of 100, the same on every run and machine."""
    return speeches(spark, d).orderBy(F.md5(F.concat(F.lit("42-"), "id")), "id").limit(100).select("id", "topic_id")


@query("T8_newest_first", "SELECT speech_giver, id, session_date, CAST(row_number() OVER (PARTITION BY speech_giver ORDER BY session_date DESC, id) AS INT) AS rank FROM speeches", "speeches")
def t8(spark, d):
    return facets.ranked(speeches(spark, d), ["speech_giver"], F.col("session_date").desc(), F.col("id")).select("speech_giver", "id", "session_date", "rank")


@query("U1_matched_and_unmatched", f"WITH {CENTRE_SQL}, {NEAREST_SQL} SELECT is_new, count(*) AS n, count(DISTINCT CASE WHEN is_new THEN vec_id ELSE topic_id END) AS topics FROM (SELECT vec_id, topic_id, sim < 0.25 AS is_new FROM near) GROUP BY 1")
def u1(spark, d):
    found = topics.assign(topic_vectors(spark, d), topics.centroids(topic_vectors(spark, d)), "vec_id", threshold=0.25)
    return found.groupBy("is_new").agg(F.count("*").alias("n"), F.count_distinct("topic_id").alias("topics"))


@query("U2_two_layouts", "SELECT id, term, NULL AS page_ref FROM speeches WHERE term <= 19 UNION ALL SELECT id, term, session_id FROM speeches WHERE term > 19", "speeches")
def u2(spark, d):
    rows = speeches(spark, d)
    return rows.where("term <= 19").select("id", "term").unionByName(rows.where("term > 19").select("id", "term", F.col("session_id").alias("page_ref")), allowMissingColumns=True)


@query("U3_union_of_terms", "SELECT party, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms FROM mps GROUP BY 1", "mps")
def u3(spark, d):
    rows = members(spark, d)
    early, late = (rows.where(c).groupBy("party").agg(F.collect_set("term").alias(n)) for c, n in (("term < 20", "a"), ("term >= 20", "b")))
    merged = early.join(late, "party", "full_outer").select("party", F.array_sort(F.array_union(F.coalesce("a", F.array().cast("array<int>")), F.coalesce("b", F.array().cast("array<int>")))).alias("t"))
    return merged.select("party", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("terms"))


@query("U4_vocabulary", "SELECT DISTINCT token FROM tokens", "tokens")
def u4(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()


@query("U5_id_sets", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings)) AS new_ids, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings)) AS both")
def u5(spark, d):
    docs, vecs = table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.exceptAll(vecs).agg(F.count("*").alias("new_ids")).crossJoin(docs.intersect(vecs).agg(F.count("*").alias("both")))


@query("U6_overlay", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v) AS v FROM (SELECT doc_id, quality AS v FROM labels) a FULL JOIN (SELECT vec_id AS doc_id, label AS v FROM embeddings) b ON a.doc_id = b.doc_id")
def u6(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("b", "a").alias("v"))


def _names(spark, d):
    """Names with what extraction leaves on them."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    tail = F.element_at(F.array(F.lit("'ın"), F.lit("’nin sözü"), F.lit(",  ek"), F.lit("; x"), F.lit("")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return rows.select("c_custkey", F.concat("n_name", F.lit("  "), "c_mktsegment", tail).alias("raw"))


NAMES_SQL = "nm AS (SELECT c_custkey, concat(n_name, '  ', c_mktsegment, [concat('''', 'ın'), '’nin sözü', ',  ek', '; x', ''][c_custkey % 5 + 1]) AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("F1_normalize_name", f"WITH {NAMES_SQL} SELECT c_custkey, trim(regexp_replace(regexp_extract(regexp_extract(raw, '^[^''’‛`]*'), '^[^,;]*'), '\\s+', ' ', 'g')) AS name FROM nm")
def f1(spark, d):
    return _names(spark, d).select("c_custkey", names.normalize_mp_name(F.col("raw")).alias("name"))


@query("F2_strip_possessive", f"WITH {NAMES_SQL} SELECT c_custkey, trim(regexp_replace(raw, '(?i)[''’]?\\s*(?:nın|nin|nun|nün|ın|in|un|ün)$', '')) AS name FROM nm")
def f2(spark, d):
    return _names(spark, d).select("c_custkey", names.strip_possessive(F.col("raw")).alias("name"))


@query("F3_normalize_raw", "SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(160), ' '), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '([A-Za-zÇĞİÖŞÜçğıöşüİıîéâûöüÂÎÛ])-\\s*([A-Za-zÇĞİÖŞÜçğıöşüİıîéâûöüÂÎÛ])', '\\1\\2', 'g')) AS clean FROM conversations")
def f3(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.normalize_raw_text(F.col("text"))).alias("clean"))


HYPHEN = "'([A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû])-\\s*([A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû])', '\\1\\2', 'g'"


@query("F4_remove_hyphens", f"SELECT doc_id, CAST(length(regexp_replace(regexp_replace(text, {HYPHEN}), {HYPHEN})) AS INT) AS chars, md5(regexp_replace(regexp_replace(text, {HYPHEN}), {HYPHEN})) AS closed FROM documents")
def f4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(text.remove_hyphens(F.col("text"))).alias("chars"), F.md5(text.remove_hyphens(F.col("text"))).alias("closed"))


@query("F5_clean_party", "WITH p AS (SELECT c_custkey, concat(c_mktsegment, ['', ' Partisi ek', ' PARTI x', ' parti'][c_custkey % 4 + 1]) AS raw FROM customer) SELECT c_custkey, coalesce(nullif(regexp_extract(raw, '(?i)^(.*?Partisi)\\b', 1), ''), nullif(regexp_extract(raw, '(?i)^(.*?Parti)\\b', 1), ''), raw) AS party FROM p")
def f5(spark, d):
    tail = F.element_at(F.array(F.lit(""), F.lit(" Partisi ek"), F.lit(" PARTI x"), F.lit(" parti")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", names.clean_party_name(F.concat("c_mktsegment", tail)).alias("party"))


@query("F6_party_without_term", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_nationkey, '.dönem ') ELSE c_mktsegment END AS party FROM (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer)")
def f6(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_nationkey", F.lit(".dönem "))).otherwise(F.concat("c_nationkey", F.lit(".dönem "), "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", names.party_without_term(raw).alias("party"))


@query("F7_session_id", "SELECT o_orderkey, concat('term', t, '-year', y, '-session', CASE WHEN t <= 22 THEN lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') ELSE CAST(o_orderkey % 1000 AS VARCHAR) END) AS session_id FROM (SELECT o_orderkey, CAST(year(o_orderdate) - 1978 AS INT) AS t, CAST(quarter(o_orderdate) AS INT) AS y FROM orders)")
def f7(spark, d):
    name = F.concat(F.lit("tbmm"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".txt"))
    return table(spark, d, "orders").select("o_orderkey", dates.session_id(name, F.year("o_orderdate") - 1978, F.quarter("o_orderdate")).alias("session_id"))


@query("F8_term_of_id", "SELECT id, term FROM speeches", "speeches")
def f8(spark, d):
    return speeches(spark, d).select("id", dates.term_of(F.col("id")).alias("term"))


@query("F9_header_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%d.%m.%Y') END AS header_date FROM orders")
def f9(spark, d):
    at = F.col("o_orderdate")
    two = lambda f: F.lpad(f(at).cast("string"), 2, "0")
    apart = lambda x, n: F.concat_ws(" ", *[F.substring(x, i, 1) for i in range(1, n + 1)])
    day, month, year = two(F.dayofmonth), two(F.month), F.year(at).cast("string")
    headers = F.array(F.concat(F.lit("x "), F.dayofmonth(at), F.lit(" ."), F.month(at), F.lit(" . "), year), F.concat(F.lit("Tarih: "), apart(day, 2), F.lit(" . "), apart(month, 2), F.lit(" . "), year), F.concat(apart(day, 2), F.lit(" . "), apart(month, 2), F.lit(" . "), apart(year, 4)), F.lit("none"))
    content = F.element_at(headers, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", dates.header_date(content).alias("header_date"))


@query("F10_calendar_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def f10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.calendar_year(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("y"))


@query("F11_labels", "SELECT s.id, CASE WHEN c.year_from IS NULL THEN concat('d', s.term, 'y', s.year) ELSE concat('d', s.term, 'y', s.year, ' (', c.year_from, '-', c.year_to, ')') END AS label, concat(c.year_from, ' (d', s.term, 'y', s.year, ')') AS short FROM speeches s JOIN calendar c ON c.term = s.term AND c.year = s.year", "speeches", "calendar")
def f11(spark, d):
    rows = speeches(spark, d).join(F.broadcast(calendar(spark)), ["term", "year"])
    return rows.select("id", dates.term_year_label(F.col("term"), F.col("year"), F.col("year_from"), F.col("year_to")).alias("label"), dates.year_label(F.col("year_from"), F.col("term"), F.col("year")).alias("short"))


@query("F12_term_spans", "WITH t AS (SELECT term, min(year_from) AS a, max(year_to) AS b FROM calendar GROUP BY 1) SELECT mp_name, string_agg(coalesce(concat(a, '-', b), concat('Term ', m.term)), ', ' ORDER BY m.term) AS spans FROM mps m LEFT JOIN t ON t.term = m.term GROUP BY 1", "mps", "calendar")
def f12(spark, d):
    spans = calendar(spark).groupBy("term").agg(F.min("year_from").alias("a"), F.max("year_to").alias("b"))
    shown = F.coalesce(F.concat("a", F.lit("-"), "b"), F.concat(F.lit("Term "), "term"))
    rows = members(spark, d).join(F.broadcast(spans), "term", "left").groupBy("mp_name").agg(F.array_sort(F.collect_list(F.struct("term", shown.alias("s")))).alias("x"))
    return rows.select("mp_name", F.array_join("x.s", ", ").alias("spans"))


@query("F13_member_id", "SELECT c_name, substr(md5(c_name), 1, 8) AS member_id FROM customer")
def f13(spark, d):
    return table(spark, d, "customer").select("c_name", names.member_id(F.col("c_name")).alias("member_id"))


CAPS_SQL = "list_transform(string_split({x}, ' '), lambda w: concat(upper(w[1]), lower(w[2:])))"


@query("F14_topic_names", f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Unknown Topic' ELSE array_to_string({CAPS_SQL.format(x='p_name')}, ' ') END AS name FROM part")
def f14(spark, d):
    raw = F.when(F.col("p_partkey") % 9 != 0, F.concat("p_partkey", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    return table(spark, d, "part").select("p_partkey", text.format_topic_name(raw).alias("name"))


def _comma(spark, d):
    """Comma lists of one to six keywords."""
    listed = F.array_join(F.slice(F.split(F.concat_ws(" ", "p_name", "p_name", "p_name"), " "), 1, (F.col("p_partkey") % 6 + 1).cast("int")), ", ")
    return table(spark, d, "part").select("p_partkey", listed.alias("k"))


COMMA_SQL = "k AS (SELECT p_partkey, list_slice(string_split(concat_ws(' ', p_name, p_name, p_name), ' '), 1, p_partkey % 6 + 1) AS l FROM part)"


@query("F15_label_of_keywords", f"WITH {COMMA_SQL} SELECT p_partkey, array_to_string(l[1:5], ', ') AS label FROM k")
def f15(spark, d):
    return _comma(spark, d).select("p_partkey", text.topic_label_of(F.col("k"), F.col("p_partkey")).alias("label"))


@query("F16_extract_keywords", f"WITH {COMMA_SQL} SELECT p_partkey, CASE WHEN len(l) > 1 THEN array_to_string(l, ', ') ELSE 'ERROR: No valid keywords generated' END AS k FROM k")
def f16(spark, d):
    raw = F.concat(F.lit("<s>soru Anahtar kelimeler: "), F.replace("k", F.lit(", "), F.lit(" ,, ")), F.lit("<|END_OF_TURN_TOKEN|>\nmore, lines"))
    return _comma(spark, d).select("p_partkey", text.extract_keywords(raw).alias("k"))


@query("F17_keyword_list", f"WITH {COMMA_SQL} SELECT p_partkey, CAST(len(l) AS INT) AS n, l[1] AS head, l[len(l)] AS tail FROM k")
def f17(spark, d):
    rows = _comma(spark, d).withColumn("l", text.keyword_list(F.col("k")))
    return rows.select("p_partkey", F.size("l").alias("n"), F.get("l", F.lit(0)).alias("head"), F.element_at("l", -1).alias("tail"))


STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("F18_clean_text", f"SELECT doc_id, md5(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\\S+|www\\S+', ' ', 'g'), '[^a-zçğıöşü\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL})), ' ')) AS clean FROM documents")
def f18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"), normalize=False)).alias("clean"))


@query("F18_clean_text_nfkc")
def f18_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean"))


@query("F19_clean_topic_name", f"SELECT p_partkey, array_to_string({CAPS_SQL.format(x='p_name')}, ' ') AS name FROM part")
def f19(spark, d):
    return table(spark, d, "part").select("p_partkey", text.clean_topic_name(F.concat(F.lit('BAŞLIK:  "'), F.upper("p_name"), F.lit("'"))).alias("name"))


@query("F20_keywords_fallback", f"WITH {COMMA_SQL}, c AS (SELECT p_partkey, list_transform(l[1:4], lambda w: concat(upper(w[1]), lower(w[2:]))) AS l FROM k) SELECT p_partkey, CASE WHEN len(l) <= 3 THEN array_to_string(l, ' ve ') ELSE array_to_string(l[1:3], ' ') END AS name FROM c")
def f20(spark, d):
    return _comma(spark, d).select("p_partkey", text.keywords_fallback(F.col("k")).alias("name"))


@query("F21_title_between_marks", "SELECT p_partkey, p_name AS title FROM part")
def f21(spark, d):
    long = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("İşte\nBaşlık: "), "p_name", F.lit("\nAçıklama"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('Bence "'), "p_name", F.lit('" uygun'))).otherwise(F.concat("p_name", F.lit("\nnot")))
    return table(spark, d, "part").select("p_partkey", text.title_between_marks(long).alias("title"))


WORDS_SQL = "SELECT doc_id, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:3], ' ') AS head, list_has_any(string_split(lower(text), ' '), ['ve', 'ile']) AS conj FROM documents"
FOLDED_SQL = "SELECT doc_id, md5(lower(translate(text, 'çğıöşüâîûÇĞİÖŞÜÂÎÛI', 'cgiosuaiucgiosuaiui'))) AS folded FROM documents"


@query("F21_long_labels", "WITH p AS (SELECT p_partkey, p_name, repeat('uzun açıklama ', 6) AS long FROM part) SELECT p_partkey, CASE WHEN p_partkey % 5 <> 3 OR (length(p_name) > 15 AND len(string_split(p_name, ' ')) > 3) THEN p_name ELSE trim(concat('**', p_name, '** ', long)) END AS label FROM p")
def f21_long(spark, d):
    """Generated labels with bold title marks; short ones stay."""
    long, name = F.lit("uzun açıklama " * 6), F.col("p_name")
    forms = [F.concat(F.lit("**başlık:** "), name, F.lit(" **gerekçe:** "), long), F.concat(long, F.lit("**BAŞLIK** "), name, F.lit('"')), F.concat(long, F.lit("**proposed Title** "), name), F.concat(F.lit("**"), name, F.lit("** "), long), name]
    return table(spark, d, "part").select("p_partkey", text.cleaned_label(F.element_at(F.array(*forms), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("label"))


@query("F22_first_words", WORDS_SQL)
def f22(spark, d):
    return table(spark, d, "documents").select("doc_id", names.first_words(F.col("text")).alias("head"), names.has_conjunction(F.col("text")).alias("conj"))


@query("F22_first_words_whole", WORDS_SQL)
def f22_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", names.first_words(F.col("text")).alias("head"), names.has_conjunction(F.col("text")).alias("conj"))


@query("F23_similarity", f"WITH RECURSIVE n AS (SELECT DISTINCT p_name AS n FROM part), {ratio_sql('SELECT x.n AS a, y.n AS b FROM n x JOIN n y ON left(x.n, 1) = left(y.n, 1)')} SELECT a, b, similarity AS ratio FROM ratio")
def f23(spark, d):
    a, b = (table(spark, d, "part").select(F.col("p_name").alias(n)).distinct() for n in ("a", "b"))
    return a.join(b, F.left("a", F.lit(1)) == F.left("b", F.lit(1))).select("a", "b", names.ratio("a", "b").alias("ratio"))


@query("F24_folded", FOLDED_SQL)
def f24(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(names.folded(F.col("text"))).alias("folded"))


SPELLED_SQL = " ".join(f"WHEN '{c}' THEN '[{of}]'" for c, of in names.SPELLINGS.items())


@query("F24_lenient_spellings", rf"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{{L}}]+')) AS word FROM documents), p AS (SELECT *, lower(translate(word, 'çğıöşüâîûÇĞİÖŞÜÂÎÛItT', 'cgiosuaiucgiosuaiuiii')) AS k, array_to_string(list_transform(string_split(word, ''), lambda c: CASE c {SPELLED_SQL} ELSE c END), '') AS pattern FROM w) SELECT a.word, b.word AS spelled FROM p a JOIN p b ON a.k = b.k AND regexp_full_match(b.word, a.pattern)")
def f24_lenient(spark, d):
    """Every word of the documents with the words that a scan may have made of it."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).distinct()
    return enrich.lenient_names(words, words.withColumnRenamed("word", "spelled"), "word", "spelled")


@query("F24_folded_whole", FOLDED_SQL)
def f24_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(names.folded(F.col("text"))).alias("folded"))


@query("F25_filter_keywords", f"WITH {COMMA_SQL}, f AS (SELECT p_partkey, l, list_filter(l, lambda w: NOT (contains(w, 'ring') OR contains('ring', w) OR contains(w, 'red') OR contains('red', w))) AS g FROM k) SELECT p_partkey, array_to_string(CASE WHEN len(g) > 0 THEN g ELSE l END, ', ') AS k FROM f")
def f25(spark, d):
    return _comma(spark, d).select("p_partkey", text.filter_keywords(F.col("k"), F.array(F.lit("Ring"), F.lit("RED"))).alias("k"))


@query("F26_stance", "SELECT mp_name, concat('Served in ', string_agg(DISTINCT party, ', ' ORDER BY party), ' with focus on Budget and related parliamentary matters.') AS stance FROM mps GROUP BY 1", "mps")
def f26(spark, d):
    rows = members(spark, d).groupBy("mp_name").agg(F.collect_list(F.concat("term", F.lit(".dönem "), "party")).alias("p"))
    return rows.select("mp_name", names.stance(F.col("p"), F.array(F.lit("Budget"), F.lit("Health"))).alias("stance"))


@query("F28_vector_functions", "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT *, first_value(e) OVER (PARTITION BY label ORDER BY vec_id) AS e0 FROM v) SELECT vec_id, round(list_cosine_similarity(e, e0), 6) AS cos, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(quantile_cont(e[1], 0.8) OVER (PARTITION BY label), 6) AS p80 FROM f")
def f28(spark, d):
    rows = table(spark, d, "embeddings").withColumn("e0", F.first("embedding").over(W.partitionBy("label").orderBy("vec_id")))
    p = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.percentile(F.get("embedding", F.lit(0)).cast("double"), 0.8), 6).alias("p80"))
    return rows.join(F.broadcast(p), "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("e0")), 6).alias("cos"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), "p80")


@query("F29_shortened", "SELECT doc_id, CASE WHEN length(text) > 250 THEN concat(left(text, 250), '...') ELSE text END AS snippet FROM documents")
def f29(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text"), 250).alias("snippet"))


@query("M1_document_keywords", "WITH tf AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT doc_id, token, tf * ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / df) AS score FROM tf JOIN df USING (token)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, token) AS rank FROM s) SELECT doc_id, string_agg(token, ', ' ORDER BY rank) AS keywords_str FROM r WHERE rank <= 10 GROUP BY 1", "tokens")
def m1(spark, d):
    top = text.best_tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("x"))
    return top.select("doc_id", F.array_join("x.token", ", ").alias("keywords_str"))


@query("M2_class_words", "WITH t AS (SELECT d.lang, k.token, count(*) AS tf FROM tokens k JOIN documents d ON d.doc_id = k.doc_id GROUP BY 1, 2), w AS (SELECT lang, sum(tf) AS words FROM t GROUP BY 1), f AS (SELECT token, sum(tf) AS freq FROM t GROUP BY 1), s AS (SELECT t.lang, t.token, CAST(tf AS DOUBLE) / words * ln(1 + (SELECT avg(words) FROM w) / freq) AS score FROM t JOIN w USING (lang) JOIN f USING (token)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, token) AS rank FROM s) SELECT lang, token, round(score, 9) AS score FROM r WHERE rank <= 10", "tokens")
def m2(spark, d):
    rows = table(spark, d, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("token"))
    scored = topics.class_tf_idf(rows, "lang")
    top = facets.ranked(scored, ["lang"], F.round("score", 12).desc(), F.col("token")).where("rank <= 10")
    return top.select("lang", "token", F.round("score", 9).alias("score"))


@query("M2_topic_model")
def m2_model(spark, d):
    from rostrum.operators import topic_model

    return topic_model.topics_of(table(spark, d, "documents"), "doc_id", "text", k=8)


@query("M2_representatives")
def m2_representatives(spark, d):
    """A model that was saved and loaded names the three documents nearest to each topic's middle."""
    from rostrum.operators import topic_model

    words = stored(topic_model.counted(topic_model.tokenized(table(spark, d, "documents"), "text").select("doc_id", "tokens"), 1 << 10), "tokens")
    model = topic_model.saved(topic_model.fit_tokens(words, 8, 1 << 10), fresh_path(spark, "topic-model"))
    return topic_model.representatives(topic_model.assigned(model, words), "doc_id")


@query("M3_assign_topics", f"WITH {CENTRE_SQL}, {NEAREST_SQL}, n AS (SELECT *, sim < 0.25 AS is_new FROM near) SELECT vec_id, CAST(CASE WHEN is_new THEN (SELECT max(topic_id) FROM centre) + row_number() OVER (PARTITION BY is_new ORDER BY vec_id) ELSE topic_id END AS INT) AS topic_id, is_new FROM n")
def m3(spark, d):
    return topics.assign(topic_vectors(spark, d), topics.centroids(topic_vectors(spark, d)), "vec_id", threshold=0.25).drop("sim")


@query("M4_refine_topic", f"WITH {CENTRE_SQL}, w AS (SELECT vec_id, max(sim) FILTER (topic_id = 4) AS own, max(sim) FILTER (topic_id <> 4) AS best, arg_max(topic_id, (round(sim, 9), -topic_id)) FILTER (topic_id <> 4) AS best_topic FROM sims WHERE label = 4 GROUP BY 1) SELECT vec_id, round(own, 6) AS own, round(best, 6) AS best, CAST(best_topic AS INT) AS best_topic, CASE WHEN best > own + 0.01 THEN 'move' WHEN own >= 0.25 THEN 'keep' ELSE 'recluster' END AS action FROM w")
def m4(spark, d):
    found = topics.refine(topic_vectors(spark, d), topics.centroids(topic_vectors(spark, d)), "vec_id", 4, margin=0.01, threshold=0.25)
    return found.select("vec_id", F.round("own", 6).alias("own"), F.round("best", 6).alias("best"), "best_topic", "action")


@query("M4_keep_closest", f"WITH {CENTRE_SQL}, s AS (SELECT vec_id, topic_id, sim FROM sims), c AS (SELECT topic_id, quantile_cont(sim, 0.8) AS cut FROM s GROUP BY 1) SELECT vec_id, topic_id FROM s JOIN c USING (topic_id) WHERE round(sim - cut, 9) >= 0")
def m4_closest(spark, d):
    sims = topics.similarities(topic_vectors(spark, d), topics.centroids(topic_vectors(spark, d)), "vec_id")
    return topics.keep_closest(sims, ["topic_id"]).select("vec_id", "topic_id")


RECLUSTERED_SQL = f"""WITH RECURSIVE {CENTRE_SQL}, w AS (SELECT vec_id, max(sim) FILTER (topic_id = 4) AS own, max(sim) FILTER (topic_id <> 4) AS best, arg_max(topic_id, (round(sim, 9), -topic_id)) FILTER (topic_id <> 4) AS best_topic FROM sims WHERE label = 4 GROUP BY 1),
act AS (SELECT vec_id, best_topic, CASE WHEN best > own + 0.01 THEN 'move' WHEN own >= 0.25 THEN 'keep' ELSE 'recluster' END AS action FROM w),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN act USING (vec_id) WHERE action = 'recluster'),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON list_cosine_similarity(a.e, b.e) >= 0.3e0),
core AS (SELECT a AS core FROM near GROUP BY 1 HAVING count(*) >= 2),
cc AS (SELECT n.a, n.b FROM near n JOIN core x ON x.core = n.a JOIN core y ON y.core = n.b),
reach AS (SELECT a, b FROM cc UNION SELECT r.a, cc.b FROM reach r JOIN cc ON cc.a = r.b),
root AS (SELECT a AS core, min(b) AS cluster FROM reach GROUP BY 1),
found AS (SELECT n.a AS vec_id, arg_min(r.cluster, (CASE WHEN r.core = n.a THEN 0 ELSE 1 END, r.core)) AS cluster FROM near n JOIN root r ON r.core = n.b GROUP BY 1),
ids AS (SELECT cluster, (SELECT max(label) FROM embeddings) + row_number() OVER (ORDER BY cluster) AS fresh FROM (SELECT DISTINCT cluster FROM found))
SELECT act.vec_id, CAST(CASE WHEN action = 'move' THEN best_topic WHEN action = 'keep' THEN 4 ELSE coalesce(fresh, -1) END AS INT) AS topic_id, action FROM act LEFT JOIN found ON found.vec_id = act.vec_id LEFT JOIN ids ON ids.cluster = found.cluster"""


@query("M4_reclustered", RECLUSTERED_SQL)
def m4_reclustered(spark, d):
    """An over-large topic after refinement: what fits neither another topic nor its own is clustered anew."""
    rows = topic_vectors(spark, d)
    actions = stored(topics.refine(rows, topics.centroids(rows), "vec_id", 4, margin=0.01, threshold=0.25))
    again = rows.join(actions.where("action = 'recluster'").select("vec_id"), "vec_id")
    clustered = cluster.dbscan(again, "vec_id", "embedding", 0.7, 2)
    return topics.refined(actions, clustered, "vec_id", 4, rows.agg(F.max("topic_id")).first()[0])


DENSITY_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND list_cosine_similarity(a.e, b.e) >= 0.4e0),
core AS (SELECT label, a AS core FROM near GROUP BY 1, 2 HAVING count(*) >= 3),
cc AS (SELECT n.label, n.a, n.b FROM near n JOIN core x ON x.label = n.label AND x.core = n.a JOIN core y ON y.label = n.label AND y.core = n.b),
reach AS (SELECT label, a, b FROM cc UNION SELECT r.label, r.a, cc.b FROM reach r JOIN cc ON cc.label = r.label AND cc.a = r.b),
root AS (SELECT label, a AS core, min(b) AS cluster FROM reach GROUP BY 1, 2),
best AS (SELECT n.label, n.a AS vec_id, arg_min(r.cluster, (CASE WHEN r.core = n.a THEN 0 ELSE 1 END, r.core)) AS cluster FROM near n JOIN root r ON r.label = n.label AND r.core = n.b GROUP BY 1, 2)
SELECT v.label, v.vec_id, coalesce(b.cluster, -1) AS cluster FROM v LEFT JOIN best b ON b.label = v.label AND b.vec_id = v.vec_id"""


@query("M5_density_clusters", DENSITY_SQL)
def m5(spark, d):
    return cluster.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6, 3, ["label"])


@query("M7_sense_timeline", f"WITH {TIMELINE_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY term, year ORDER BY size DESC, label) AS r FROM f) SELECT label, term, year, size, round(z, 6) AS z FROM g WHERE r <= 3", "speeches")
def m7(spark, d):
    moved = drift.drift(timeline(spark, d), ["label"], ["term", "year"], "centroid", "size")
    return facets.ranked(moved, ["term", "year"], F.col("size").desc(), F.col("label")).where("rank <= 3").select("label", "term", "year", "size", F.round("z", 6).alias("z"))


@query("M8_projection")
def m8(spark, d):
    return cluster.project(table(spark, d, "embeddings"), "embedding").select("vec_id", F.get("projection", F.lit(0)).alias("x"), F.get("projection", F.lit(1)).alias("y"))


@query("M9_sweep")
def m9(spark, d):
    return cluster.sweep(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", [4, 10])


@query("M6_aligned_senses")
def m6(spark, d):
    rows = table(spark, d, "embeddings").join(speeches(spark, d).select("speech_key", "term", "year"), F.col("vec_id") == F.col("speech_key")).select("vec_id", "embedding", "term", "year")
    local = cluster.period_clusters(rows, "vec_id", "embedding", 0.7, 2, 30)
    return cluster.align(local, 0.3).select("term", "year", "cluster", "size", "global_id")


@query("M6_aligned_words")
def m6_words(spark, d):
    """Senses of every keyword at once: contexts of its speeches, clustered by term, aligned from term to term."""
    dated = speeches(spark, d).select("speech_key", "term", F.lit(1).alias("year"))
    rows = keywords(spark, d).join(dated, "speech_key").join(table(spark, d, "embeddings"), F.col("speech_key") == F.col("vec_id")).select("keyword", "vec_id", "embedding", "term", "year")
    local = cluster.period_clusters(rows, "vec_id", "embedding", 0.7, 2, 30, ["keyword"])
    return cluster.align(local, 0.3, words=["keyword"]).select("keyword", "term", "cluster", "size", "global_id")
