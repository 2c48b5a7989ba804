"""Lookups, upserts and merges between speeches and their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rostrum.functions import names
from rostrum.operators.facets import best, ranked
from rostrum.sources.store import stored


def exact_party(speeches: DataFrame, members: DataFrame) -> DataFrame:
    """Adds party by (term, speech_giver)."""
    return speeches.join(members.withColumnRenamed("mp_name", "speech_giver"), ["term", "speech_giver"], "left")


def fuzzy_party(speeches: DataFrame, members: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Adds party by (term, speech_giver); names that the term lacks take the most similar one's, if similar enough.
    Only distinct unmatched names are compared, only with those that share a block, and only where the lengths and letters
    allow the threshold; no match is lost."""
    exact = exact_party(speeches, members)
    missing = exact.where("party is null").select("term", "speech_giver").distinct()
    candidates = members.where("party is not null")
    every = missing.select(F.col("speech_giver").alias("n")).union(candidates.select("mp_name")).where("n is not null").distinct()
    blocks = stored(letter_blocks(every, "n", threshold), "name-blocks")
    mine = missing.join(blocks.withColumnRenamed("n", "speech_giver"), "speech_giver")
    theirs = candidates.join(blocks.withColumnRenamed("n", "mp_name"), "mp_name")
    pairs = mine.join(theirs, ["term", "block"]).select("term", "speech_giver", "mp_name", "party")
    for bound in (names.length_bound, names.letters_bound):
        pairs = pairs.where(bound(F.lower("mp_name"), F.lower("speech_giver")) >= threshold - 1e-9)
    scored = pairs.distinct().withColumn("similarity", names.ratio("mp_name", "speech_giver")).where(F.col("similarity") >= threshold)
    found = best(scored, ["term", "speech_giver"], F.col("similarity").desc(), F.col("mp_name").desc()).select("term", "speech_giver", F.col("party").alias("fuzzy"))
    return exact.join(found, ["term", "speech_giver"], "left").withColumn("party", F.coalesce("party", "fuzzy")).drop("fuzzy")


def letter_blocks(rows: DataFrame, name: str, threshold: float) -> DataFrame:
    """name, block: any two names whose similarity reaches the threshold share a block. rows has each name once.

    A letter's second occurrence is another letter, so what two names share is the overlap of two sets. Similar names share
    at least threshold / (2 - threshold) of the letters of either; in one order of letters, rarest first, two of those stand
    among the letters that remain without all but two of them. Each pair of these is a block. Names so short that one
    shared letter can be enough are blocked by each letter too."""
    lower = rows.select(name, F.lower(name).alias("l")).where("l <> ''")
    letters = F.expr("transform(sequence(1, length(l)), i -> concat(substring(l, i, 1), length(left(l, i)) - length(replace(left(l, i), substring(l, i, 1), ''))))")
    each = lower.select(name, F.length("l").alias("size"), F.explode(letters).alias("letter"))
    each = each.join(each.groupBy("letter").agg(F.count("*").alias("names")), "letter")
    needed = F.ceil(F.col("size") * threshold / (2 - threshold) - 1e-9).cast("int")
    # A name's letters are as many as it is long.
    own = each.groupBy(name, "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("names", "letter"))), lambda x: x["letter"]).alias("all"))
    first = own.select(name, "size", "all", F.slice("all", F.lit(1), F.col("size") - needed + 2).alias("p"))
    pairs = F.expr("flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> concat(x, ' ', y))))")
    single = F.when(F.col("size") <= max(1.0, 2 / threshold - 1), F.col("all")).otherwise(F.array().cast("array<string>"))
    return first.select(name, F.explode(F.concat(pairs, single)).alias("block"))


def similar_names(members: DataFrame, name: str = "speech_giver", threshold: float = 0.9, words: int = 3) -> DataFrame:
    """name_a, name_b, similarity, ordered pairs of different names whose first words are similar. Only names that share a
    block (`letter_blocks`) are compared, and only where lengths and letters allow the threshold. No pair is lost."""
    short = names.first_words(F.col(name), words)
    keyed = stored(members.select(F.col(name).alias("n"), short.alias("s")).where("n is not null").distinct(), "names")
    blocks = stored(letter_blocks(keyed.select("s").distinct(), "s", threshold), "name-blocks")
    a, b = blocks.toDF("s_a", "block"), blocks.toDF("s_b", "block")
    # Each pair of first words is scored once, however many names begin with them.
    pairs = a.join(b, "block")
    for bound in (names.length_bound, names.letters_bound):
        pairs = pairs.where(bound(F.lower("s_b"), F.lower("s_a")) >= threshold - 1e-9)
    scored = stored(pairs.select("s_a", "s_b").distinct().withColumn("similarity", names.ratio("s_b", "s_a")).where(F.col("similarity") >= threshold), "similar")
    both = scored.join(keyed.toDF("name_a", "s_a"), "s_a").join(keyed.toDF("name_b", "s_b"), "s_b")
    return both.where("name_a <> name_b").select("name_a", "name_b", "similarity")


def ranked_matches(pairs: DataFrame, members: DataFrame, name: str = "speech_giver", party: str = "party") -> DataFrame:
    """Adds rank to similar names: for each name_a the most similar first, of equal ones those with a party, then by name."""
    known = members.groupBy(F.col(name).alias("name_b")).agg(F.max(F.coalesce(F.col(party), F.lit("")) != "").alias("has_party"))
    return ranked(pairs.join(known, "name_b", "left"), ["name_a"], F.col("similarity").desc(), F.col("has_party").desc_nulls_last(), F.col("name_b"))


def close_names(members: DataFrame, name: str, most: int = 1) -> DataFrame:
    """name_a < name_b within an edit distance; blocked by length and by pieces of the name, of which an edit leaves one."""
    base = members.select(F.col(name).alias("n")).where("n is not null").distinct()
    size = F.length("n")
    piece = F.ceil(size / (most + 1)).cast("int")
    keyed = base.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(k.alias("k"), F.col("n").substr(k * piece + 1, piece).alias("p")))).alias("q"), size.alias("len"))
    sent = keyed.select(F.col("n").alias("name_a"), "len", F.col("q.k").alias("k"), F.col("q.p").alias("p"))
    # The other side offers each of its pieces at every shift the edits allow, for every length they allow.
    spans = base.select(F.col("n").alias("name_b"), F.explode(F.sequence(F.greatest(F.lit(0), size - most), size + most)).alias("len"))
    width = F.ceil(F.col("len") / (most + 1)).cast("int")
    offers = spans.select("name_b", "len", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    offers = offers.select("name_b", "len", "k", "w", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift"))
    at = F.col("k") * F.col("w") + F.col("shift") + 1
    left = F.least(F.col("w"), F.col("len") - F.col("k") * F.col("w"))
    offers = offers.where((at >= 1)).select("name_b", "len", "k", F.col("name_b").substr(at, left).alias("p")).distinct()
    pairs = sent.join(offers, ["len", "k", "p"]).where("name_a <> name_b").select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).distinct()
    return pairs.where(F.levenshtein("name_a", "name_b") <= most)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of either; new's non-null values win, columns that new lacks stay. new has one row for each key."""
    shared = [c for c in new.columns if c != key]
    joined = old.join(new.select(key, *[F.col(c).alias(f"__new_{c}") for c in shared]), key, "full_outer")
    merged = lambda c: F.coalesce(f"__new_{c}", c).alias(c) if c in shared else F.col(c)
    return joined.select(*[merged(c) for c in old.columns])


def backfill(df: DataFrame, column: str, found: Column) -> DataFrame:
    """Fills the column only where it is missing."""
    return df.withColumn(column, F.coalesce(F.col(column), found))


def relabel(speeches: DataFrame, labels: DataFrame) -> DataFrame:
    """New labels (topic_id, new_label) for every row of their topics, with a `changed` mark."""
    joined = speeches.join(labels, "topic_id", "left")
    return joined.withColumn("changed", F.col("new_label").isNotNull() & ~F.col("new_label").eqNullSafe(F.col("topic_label"))).withColumn("topic_label", F.coalesce("new_label", "topic_label")).drop("new_label")


def plan_ingest(arriving: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Adds action: insert or update."""
    known = stored.select(key, F.lit("update").alias("action"))
    return arriving.join(known, key, "left").withColumn("action", F.coalesce("action", F.lit("insert")))


def quarantine(df: DataFrame, raw: str, parsed: Column, good: str) -> DataFrame:
    """Adds the parsed value and a reason where a raw value is there that can't be parsed."""
    out = df.withColumn(good, parsed)
    return out.withColumn("reason", F.when(F.col(raw).isNotNull() & F.col(good).isNull(), F.concat(F.lit("bad date: "), raw)))


def pivot_members(members: DataFrame, terms: list[int] | None = None) -> DataFrame:
    """speech_giver, term17 ... : the party by term, empty where a member did not serve; the last name wins a clash. All
    terms there are, unless some are named."""
    if terms is None:
        terms = sorted(r["term"] for r in members.select("term").where("term is not null").distinct().collect())
    wide = members.groupBy(F.col("mp_name").alias("speech_giver")).pivot("term", terms).agg(F.max("party"))
    return wide.select("speech_giver", *[F.coalesce(F.col(f"`{t}`"), F.lit("")).alias(f"term{t}") for t in terms])


def unpivot_members(wide: DataFrame) -> DataFrame:
    """speech_giver, parties (`N.dönem Party`, by term), terms."""
    columns = [c for c in wide.columns if c.startswith("term")]
    long = wide.unpivot("speech_giver", columns, "column", "party").where("party <> ''").withColumn("term", F.substring("column", 5, 9).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("term", "party")))
    grouped = long.groupBy("speech_giver").agg(listed.alias("x"))
    return grouped.select("speech_giver", F.transform("x", lambda s: F.concat(s["term"], F.lit(".dönem "), s["party"])).alias("parties"), F.col("x.term").alias("terms"))


def merge_names(rows: DataFrame) -> DataFrame:
    """rows: pos, name, party, terms. Rows whose normalised names agree become one: first party that is set, all terms."""
    keyed = rows.withColumn("norm", names.normalize_mp_name(F.col("name")))
    first = F.min_by("party", F.when(F.coalesce("party", F.lit("")) != "", F.col("pos")))
    set_party = F.when(F.count_if(F.coalesce("party", F.lit("")) != "") > 0, first)
    merged = keyed.groupBy("norm").agg(set_party.alias("party"), F.count("*").alias("merged"))
    return _with_terms(merged, keyed, "norm").select("norm", "party", "terms", "merged")


def _with_terms(merged: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds the distinct terms of a key's rows; only distinct ones are gathered."""
    terms = rows.select(key, F.explode("terms").alias("term")).groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    kind = dict(rows.dtypes)["terms"]
    return merged.join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast(kind)))


def canonical_names(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows: name, party, terms; groups: name, root. For each group the name with the best score (party 100, 10 a term,
    less its length), its merged party and terms, and how many names it stands for."""
    joined = rows.join(groups, "name")
    score = F.when(F.coalesce("party", F.lit("")) != "", 100).otherwise(0) + F.coalesce(F.size("terms"), F.lit(0)) * 10 - F.length("name")
    scored = joined.withColumn("score", score)
    order = F.struct(-F.col("score"), "name")
    party = F.min_by("party", F.when(F.coalesce("party", F.lit("")) != "", order))
    merged = scored.groupBy("root").agg(F.min_by("name", order).alias("canonical"), party.alias("party"), F.count("*").alias("names"))
    return _with_terms(merged, scored, "root").select("root", "canonical", "party", "terms", "names")


def attach_links(nested: DataFrame, links: DataFrame) -> DataFrame:
    """Fills empty links of nested entities from links (entity, link); looked up once for each entity."""
    flat = nested.select("speech_key", F.posexplode("ner_entities").alias("pos", "e"))
    wanted = flat.where("coalesce(e.wikipedia_url, '') = ''").select(F.col("e.entity").alias("entity")).distinct()
    found = wanted.join(links, "entity")
    filled = flat.join(found, flat["e.entity"] == found["entity"], "left")
    element = F.col("e").withField("wikipedia_url", F.coalesce(F.nullif("e.wikipedia_url", F.lit("")), "link"))
    return filled.groupBy("speech_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", element.alias("e")))), lambda s: s["e"]).alias("ner_entities"))


def lenient_names(known: DataFrame, found: DataFrame, name: str, spelled: str) -> DataFrame:
    """Rows of known joined to those of found whose `spelled` the lenient pattern of `name` matches as a whole. They meet by
    the key that all spellings of a name share, so no match is lost and only names of one key are compared; null and empty
    names match nothing."""
    left = known.where(F.length(name) > 0).withColumn("__key", names.spelling_key(F.col(name)))
    right = found.where(F.length(spelled) > 0).withColumn("__key", names.spelling_key(F.col(spelled)))
    whole = F.concat(F.lit("^(?:"), names.lenient_pattern(F.col(name)), F.lit(r")\z"))
    return left.join(right, "__key").where(F.regexp_like(F.col(spelled), whole)).drop("__key")
