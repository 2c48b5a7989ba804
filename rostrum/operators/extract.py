"""From transcripts to speeches: index entries, bodies, links and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import dates, names, text

#: What index headers, entries and speech ends look like in the two layouts (fixed values).
HEADER_A = r"(?iu)GÜNDEM\s*D[Iİıi]Ş[Iİıi]\s*KONUŞMALAR"
ENTRY_A = r"(?iu)^\s*(\d+)\.\s*[-—]*\s*(.+?)\s+(?:Milletvekili|Bakan[ıi]?)\s+(.+?)['’]?(?:nın|nin|nun|nün|ın|in|un|ün)\s*,\s*(.*?)\s*konuşmas"
HEADER_B = r"(?iu)^\s*[IVXLCDM]+\.-\s*AÇIKLAMALAR"
ENTRY_B = r"(?iu)^\s*(\d+)\.-\s*(.+?)\s+Milletvekili\s+(.+?)['’]?(?:nın|nin|nun|nün|ın|in|un|ün),\s*(.*?)\s*açıklaması+\s*(\d+(?::\d+)?)?"
SECTION = r"^\s*[IVXLCDM]+\.-"
CHAIR = r"(?iu)^\s*BAŞKAN\s*[-—]"
PAGE_LINK = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'


def lines_of(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """key, pos, line. Hyphenated breaks between letters are closed first."""
    return files.select(key, F.posexplode(F.split(text.normalize_raw_text(F.col(content)), "\n")).alias("pos", "line"))


def entries(lines: DataFrame, pattern: str, page: bool = False, key: str = "file") -> DataFrame:
    """key, pos, speech_no, province, speech_giver, speech_title[, page_ref] for each line that is an index entry."""
    part = lambda g: F.regexp_extract("line", pattern, g)
    clean = lambda c: text.one_spaced(c)
    columns = [part(1).cast("int").alias("speech_no"), names.strip_possessive(clean(part(2))).alias("province"), names.normalize_mp_name(clean(part(3))).alias("speech_giver"), clean(part(4)).alias("speech_title")]
    if page:
        columns.append(part(5).alias("page_ref"))
    return lines.where(F.col("line").rlike(pattern)).select(key, "pos", *columns)


def numbered_from_one(rows: DataFrame, keys: list[str], number: str, order: str) -> DataFrame:
    """Rows of each key as long as they are numbered 1, 2, 3 ...; what comes after the first gap goes."""
    by = W.partitionBy(*keys).orderBy(order)
    counted = rows.withColumn("__n", F.row_number().over(by))
    held = F.bool_and(F.col(number) == F.col("__n")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    return counted.withColumn("__held", held).where("__held").drop("__n", "__held")


def speeches_with_index(files: DataFrame) -> DataFrame:
    """Layout with an index under the first header and speeches after the second: key, entry columns, content. A speech
    runs from its speaker's line to the next numbered line, the chair's words, or the end; entries without a body go."""
    lines = lines_of(files)
    by = W.partitionBy("file").orderBy("pos")
    marked = lines.withColumn("part", F.sum(F.col("line").rlike(HEADER_A).cast("int")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    section = F.col("line").rlike(r"^\s*(?:[B-Z]\)|[IVXL]+\.)")
    index = marked.where("part = 1").withColumn("closed", F.coalesce(F.max(section).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(False))).where("not closed")
    listed = numbered_from_one(entries(index, ENTRY_A), ["file"], "speech_no", "pos").drop("pos")
    body = marked.where("part >= 2").withColumn("number", F.regexp_extract("line", r"^\s*(\d+)\.\s*[-—]", 1).try_cast("int"))
    # The chair ends a speech without beginning the next.
    end = F.col("line").rlike(CHAIR)
    body = body.withColumn("speech_no", F.last("number", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    body = body.withColumn("silent", F.max(end & F.col("number").isNull()).over(W.partitionBy("file", "speech_no").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    said = body.where("speech_no is not null and number is null and not silent").groupBy("file", "speech_no").agg(_joined().alias("content"))
    return listed.join(said.where("content <> ''"), ["file", "speech_no"])


def speeches_in_section(files: DataFrame) -> DataFrame:
    """Layout whose entries come twice, in the section's index and before each speech: key, entry columns, content. A
    speech without a body keeps empty content."""
    lines = lines_of(files)
    by = W.partitionBy("file").orderBy("pos")
    found = entries(lines, ENTRY_B, page=True)
    nth = found.withColumn("nth", F.row_number().over(W.partitionBy("file", "speech_no").orderBy("pos")))
    listed = numbered_from_one(nth.where("nth = 1"), ["file"], "speech_no", "pos").drop("pos", "nth")
    starts = nth.where("nth = 2").select("file", "pos", "speech_no")
    marks = lines.join(starts, ["file", "pos"], "left").withColumn("mark", F.col("line").rlike(ENTRY_B) | F.col("line").rlike(SECTION))
    group = F.sum(F.col("mark").cast("int")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    grouped = marks.withColumn("part", group)
    head = grouped.where("speech_no is not null").select("file", "part", "speech_no")
    body = grouped.where("not mark").drop("speech_no").join(head, ["file", "part"])
    said = body.groupBy("file", "speech_no").agg(_joined().alias("content"))
    return listed.join(said, ["file", "speech_no"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def _joined() -> Column:
    """Lines of a group in order, single spaces. A group is one speech, so its size has the file's bound."""
    return text.one_spaced(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), " "))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, no, href, label for each link."""
    hrefs, labels = (F.regexp_extract_all("html", F.lit(PAGE_LINK), F.lit(g)) for g in (1, 2))
    return pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("no", "x")).select("page_id", "no", "x.href", "x.label")


def party_for_term(page: Column, term: Column) -> Column:
    """The party in `N. Dönem Party Province Milletvekili`, with or without the spaces, for the given term."""
    upper, lower = "A-ZÇĞİÖŞÜ", "a-zçğıöşü"
    found = F.regexp_extract_all(F.regexp_replace(page, "<[^>]*>", "\n"), F.lit(r"(\d+)\.\s*Dönem([^\n]+?Milletvekili)"), F.lit(0))
    mine = F.get(F.filter(found, lambda x: F.startswith(x, F.concat(term.cast("string"), F.lit(".")))), F.lit(0))
    take = lambda p: F.nullif(F.trim(F.regexp_extract(mine, p, 1)), F.lit(""))
    return F.coalesce(take(rf"Dönem([{upper}].+?)[{upper}][{lower}]+Milletvekili"), take(rf"Dönem\s+(.+?)\s+[{upper}][{lower}]+\s+Milletvekili"), take(rf"Dönem\s*(.+?)\s*Milletvekili"))  # noqa: F541


def session_dates(files: DataFrame) -> DataFrame:
    return files.withColumn("session_date", dates.header_date(F.col("content")))


def date_statistics(dated: DataFrame, directory: str = "dir") -> DataFrame:
    """dir (null for the total), files, found, rate."""
    return dated.rollup(directory).agg(F.count("*").alias("files"), F.count_if(F.col("session_date").isNotNull()).alias("found")).withColumn("rate", F.round(F.col("found") * 100.0 / F.col("files"), 1))
