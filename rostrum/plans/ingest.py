"""Files out and in: transcripts, dimension tables and exports, written from the tables and read back (S, F27, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text
from rostrum.operators import extract, facets
from rostrum.plans.registry import query
from rostrum.plans.streams import _places
from rostrum.sources import files
from rostrum.sources.fixtures import members, speeches, table

BODY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(160), ' '), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '([A-Za-zÇĞİÖŞÜçğıöşüİıîéâûöüÂÎÛ])-\\s*([A-Za-zÇĞİÖŞÜçğıöşüİıîéâûöüÂÎÛ])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"


def transcripts(spark, d):
    """file, content: each conversation as a session whose turns are speeches, first listed, then held."""
    turns = table(spark, d, "conversations")
    number = F.col("turn") + 1
    entry = F.concat(number, F.lit(".- Ankara Milletvekili Ayşe "), F.initcap("role"), F.lit("'ın, konu "), number, F.lit(" hakkında açıklaması 1:"), number + 10)
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry"), "text"))).alias("t"))
    index = F.array_join(F.col("t.entry"), "\n")
    bodies = F.array_join(F.transform("t", lambda x: F.concat(x["entry"], F.lit("\n"), x["text"])), "\n")
    return per.select("conv_id", F.col("conv_id").cast("string").alias("file"), F.concat(F.lit("V.- AÇIKLAMALAR\n"), index, F.lit("\n"), bodies).alias("content"))


@query("F27_index_entries", "SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INT) AS speech_no, 'Ankara' AS province, concat('Ayşe ', upper(role[1]), role[2:]) AS speech_giver, concat('konu ', turn + 1, ' hakkında') AS speech_title, concat('1:', turn + 11) AS page_ref, 2 AS times FROM conversations")
def f27(spark, d):
    found = extract.entries(extract.lines_of(transcripts(spark, d)), extract.ENTRY_B, page=True)
    return found.groupBy("file", "speech_no", "province", "speech_giver", "speech_title", "page_ref").agg(F.count("*").cast("int").alias("times"))


@query("J6_bodies", f"SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INT) AS speech_no, md5({BODY_SQL}) AS body FROM conversations")
def j6(spark, d):
    return extract.speeches_in_section(transcripts(spark, d)).select("file", "speech_no", F.md5("content").alias("body"))


def index_transcripts(spark, d):
    """file, content: conversations in the older layout, an index under one header and the speeches after a second."""
    turns = table(spark, d, "conversations").where("conv_id % 2 = 0")
    number = F.col("turn") + 1
    entry = F.concat(number, F.lit(".- Ankara Milletvekili Ayşe "), F.initcap("role"), F.lit("'ın, konu "), number, F.lit(" hakkında konuşması"))
    head = F.concat(number, F.lit(".- AYŞE "), F.upper("role"), F.lit(" (Ankara)"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("entry"), head.alias("head"), "text"))).alias("t"))
    title = F.lit("GÜNDEM DIŞI KONUŞMALAR\n")
    bodies = F.array_join(F.transform("t", lambda x: F.concat(x["head"], F.lit("\n"), x["text"])), "\n")
    return per.select(F.col("conv_id").cast("string").alias("file"), F.concat(title, F.array_join(F.col("t.entry"), "\n"), F.lit("\n"), title, bodies).alias("content"))


@query("U2_two_eras", f"SELECT file, speech_no, speech_giver, md5(body) AS body, page_ref FROM (SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INT) AS speech_no, concat('Ayşe ', upper(role[1]), role[2:]) AS speech_giver, {BODY_SQL} AS body, CASE WHEN conv_id % 2 = 1 THEN concat('1:', turn + 11) END AS page_ref, conv_id FROM conversations) WHERE conv_id % 2 = 1 OR body <> ''")
def u2_eras(spark, d):
    """Both extractors, each over the sessions of its own layout, into one table."""
    older = extract.speeches_with_index(index_transcripts(spark, d)).withColumn("page_ref", F.lit(None).cast("string"))
    newer = extract.speeches_in_section(transcripts(spark, d).where("conv_id % 2 = 1"))
    rows = older.select("file", "speech_no", "speech_giver", "content", "page_ref").unionByName(newer.select("file", "speech_no", "speech_giver", "content", "page_ref"))
    return rows.select("file", "speech_no", "speech_giver", F.md5("content").alias("body"), "page_ref")


@query("S15_party_for_term", "SELECT term, mp_name, party FROM mps", "mps")
def s15_party(spark, d):
    """A page for each member, which names the party of each term in one of three ways."""
    rows = members(spark, d)
    way = F.pmod(F.col("term"), F.lit(3))
    line = F.when(way == 0, F.concat("term", F.lit(". Dönem"), "party", F.lit("AnkaraMilletvekili"))).when(way == 1, F.concat("term", F.lit(". Dönem "), "party", F.lit(" Ankara Milletvekili"))).otherwise(F.concat("term", F.lit(". Dönem "), "party", F.lit(" Milletvekili")))
    pages = rows.groupBy("mp_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", line.alias("line")))), lambda x: F.concat(F.lit("<li>"), x["line"], F.lit("</li>"))), "").alias("html"))
    return rows.select("term", "mp_name").join(pages, "mp_name").select("term", "mp_name", extract.party_for_term(F.col("html"), F.col("term")).alias("party"))


def _written(spark, d) -> str:
    """Session texts by term and year, as folders of text files."""
    out, _ = _places(spark)
    rows = speeches(spark, d).select(F.concat(F.lit("d"), "term", F.lit("-y"), "year").alias("dir"), F.col("id").alias("value"))
    rows.repartition("dir").write.partitionBy("dir").text(out)
    return out


@query("S1_discover", "SELECT term, year, CAST(sum(length(id) + 1) AS BIGINT) AS chars FROM speeches GROUP BY 1, 2", "speeches")
def s1(spark, d):
    found = files.transcripts(spark, _written(spark, d))
    return found.groupBy("term", "year").agg(F.sum(F.length("content")).alias("chars"))


@query("S2_census", "SELECT DISTINCT concat('d', term, '-y', year) AS dir, CAST(0 AS BIGINT) AS excluded FROM speeches", "speeches")
def s2(spark, d):
    found = files.census(spark, _written(spark, d))
    return found.where("counted > 0").select(F.regexp_extract("dir", r"([^=/]+)$", 1).alias("dir"), "excluded")


@query("S3_dimension", "SELECT term, mp_name, party FROM mps", "mps")
def s3(spark, d):
    out, _ = _places(spark)
    members(spark, d).select("term", F.concat(F.lit("  "), "mp_name", F.lit(" ")).alias("mp_name"), "party").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return files.dimension(spark, out, "term int, mp_name string, party string")


@query("S12_export", "WITH f AS (SELECT * FROM speeches WHERE topic_id NOT IN (-1, 1)), l AS (SELECT topic_id, topic_label, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, topic_label) AS r FROM f GROUP BY 1, 2) SELECT f.topic_id, min(l.topic_label) AS topic_label, count(*) AS speech_count FROM f JOIN l ON l.topic_id = f.topic_id AND l.r = 1 GROUP BY 1", "speeches")
def s12(spark, d):
    out, _ = _places(spark)
    files.export_csv(facets.topic_statistics(speeches(spark, d)), out)
    back = spark.read.option("header", True).csv(out)
    return back.select(F.col("topic_id").cast("int").alias("topic_id"), "topic_label", F.col("speech_count").cast("long").alias("speech_count"))


@query("S12_backup", "SELECT id, topic_id, session_date FROM speeches", "speeches")
def s12_backup(spark, d):
    out, _ = _places(spark)
    rows = speeches(spark, d).select("id", "topic_id", "session_date")
    files.export_json(rows, out)
    return spark.read.schema(rows.schema).json(out)


@query("P10_cleaned_turns", "SELECT conv_id, turn, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean FROM conversations")
def cleaned(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.one_spaced(F.col("text"))).alias("clean"))
