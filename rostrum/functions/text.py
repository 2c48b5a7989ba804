"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.sources.store import stored

#: Markers that generated text carries (fixed values).
SPECIAL_TOKENS = ("<|START_OF_TURN_TOKEN|>", "<|END_OF_TURN_TOKEN|>", "<|CHATBOT_TOKEN|>", "<|USER_TOKEN|>", "<|SYSTEM_TOKEN|>", "<BOS_TOKEN>", "<EOS_TOKEN>", "<s>", "</s>")
KEYWORDS_MARK = "Anahtar kelimeler:"
NO_KEYWORDS = "ERROR: No valid keywords generated"
#: Additional stop words of cleaned text (fixed values); callers may pass a longer list.
STOP_WORDS = ("bir", "sayın", "başkan", "ve", "ile", "de", "da", "der", "derler", "derleri", "dahi", "ancak", "fakat", "şu", "bu", "o", "ki", "gibi", "olan", "bunun")
#: Institution names that never make a topic (fixed values).
INSTITUTIONS = ("Meclis", "TBMM", "parlamento", "Meclis Başkanı", "Başkan", "Milletvekili", "Komisyon", "Bakan", "Bakanlık", "Genel Kurul")
LETTERS = "A-Za-zÇĞİÖŞÜçğıöşüİıîéâûöüÂÎÛ"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), F.lit(1))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_raw_text(text: Column) -> Column:
    """Soft hyphens go, no-break spaces become spaces, hyphenated breaks between letters close."""
    text = F.translate(F.replace(text, F.lit("­"), F.lit("")), " ", " ")
    text = F.regexp_replace(text, r"((?U)\w)-\n((?U)\w)", "$1$2")
    return F.regexp_replace(text, rf"([{LETTERS}])-(?U)\s*([{LETTERS}])", "$1$2")


def remove_hyphens(text: Column) -> Column:
    """Layout hyphens between letters go, with the space after them."""
    letters = "A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû"
    return F.regexp_replace(text, rf"(?<=[{letters}])-\s*(?=[{letters}])", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_text(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, normalize: bool = True) -> Column:
    """Lower-cased letters only, without links, stop words and words under three letters."""
    text = F.lower(nfkc(text) if normalize else text)
    text = F.regexp_replace(F.regexp_replace(text, r"http\S+|www\S+", " "), r"[^a-zçğıöşü\s]", " ")
    words = F.filter(F.split(one_spaced(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def extract_keywords(generated: Column) -> Column:
    """Comma list after the last marker-free first line of generated text, or an error mark."""
    tail = F.when(F.contains(generated, F.lit(KEYWORDS_MARK)), F.substring(generated, F.instr(generated, KEYWORDS_MARK) + len(KEYWORDS_MARK), F.length(generated))).otherwise(generated)
    line = F.trim(F.get(F.split(F.regexp_replace(tail, r"^\s+|\s+$", ""), "\n"), F.lit(0)))
    line = reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), SPECIAL_TOKENS, line)
    parts = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(parts, ", ")
    return F.when((F.length(joined) >= 3) & (F.size(parts) > 1), joined).otherwise(NO_KEYWORDS)


def keyword_list(keywords: Column) -> Column:
    return F.transform(F.split(keywords, ","), lambda x: F.trim(x))


def topic_label_of(keywords: Column, topic_id: Column, n: int = 5) -> Column:
    """First n of a comma list, or `Topic N`."""
    listed = F.array_join(F.slice(keyword_list(keywords), 1, n), ", ")
    return F.when(F.coalesce(keywords, F.lit("")) == "", F.concat(F.lit("Topic "), topic_id)).otherwise(listed)


def format_topic_name(name: Column) -> Column:
    """`23_a_b` as `A B`; a missing name as `Unknown Topic`."""
    body = F.when(F.contains(name, F.lit("_")), F.substring(name, F.instr(name, "_") + 1, F.length(name))).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown Topic").otherwise(F.initcap(one_spaced(F.translate(body, "_", " "))))


def clean_topic_name(name: Column) -> Column:
    """Without title prefix and quotes, each word capitalised."""
    name = F.regexp_replace(name, r"(?iu)^(Başlık:|Konu:|Topic:)\s*", "")
    words = F.filter(F.split(one_spaced(F.translate(name, "\"'", "")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(w.substr(F.lit(2), F.length(w))))), " ")


def keywords_fallback(keywords: Column) -> Column:
    """Up to three words joined by ` ve `; of four or more the first three joined by spaces."""
    words = F.transform(F.slice(F.split(keywords, ","), 1, 4), lambda w: F.concat(F.upper(F.left(F.trim(w), F.lit(1))), F.lower(F.trim(w).substr(F.lit(2), F.length(w)))))
    return F.when(F.size(words) <= 3, F.array_join(words, " ve ")).otherwise(F.array_join(F.slice(words, 1, 3), " "))


def title_between_marks(label: Column) -> Column:
    """The title in an over-long generated label: between bold marks, after a title mark, within quotes, or the first line.
    Bold marks: `**başlık:** X **gerekçe:** ...`, `... **başlık** X"`, `... **proposed Title** X`, or `**X** ...` where X has
    more than 15 letters and more than 3 words."""
    marked = F.regexp_extract(label, r"(?isu)\*\*\s*(?:başlık|proposed title)\s*:?\s*\*\*:?\s*(.+?)\s*(?:\*\*.*|\"\s*)?$", 1)
    bold = F.regexp_extract(label, r"^\s*\*\*\s*([^*]+?)\s*\*\*", 1)
    bold = F.when((F.length(bold) > 15) & (F.size(F.split(bold, r"\s+")) > 3), bold)
    after = F.regexp_extract(label, r"(?iu)(?:Başlık|Konu|Topic):\s*\"?([^\"\n]+)", 1)
    quoted = F.regexp_extract(label, r'"([^"\n]+)"', 1)
    return F.trim(F.coalesce(F.nullif(marked, F.lit("")), bold, F.nullif(after, F.lit("")), F.nullif(quoted, F.lit("")), F.get(F.split(label, "\n"), F.lit(0))))


def cleaned_label(label: Column, longest: int = 60) -> Column:
    """Labels of more than 60 letters give way to their title."""
    return F.when(F.length(label) > longest, title_between_marks(label)).otherwise(label)


def filter_keywords(keywords: Column, common_words: Column) -> Column:
    """Keywords that neither contain nor are contained in a common word; all of them if none is left."""
    parts = F.filter(keyword_list(keywords), lambda k: k != "")
    overlaps = lambda k: F.exists(common_words, lambda s: F.contains(F.lower(k), F.lower(s)) | F.contains(F.lower(s), F.lower(k)))
    left = F.filter(parts, lambda k: ~overlaps(k))
    return F.when(F.size(left) > 0, F.array_join(left, ", ")).otherwise(keywords)


def shortened(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, tf. Texts are dealt by key before they are taken apart, so tokens don't travel."""
    return docs.select(key, text).repartition(F.col(key)).select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


#: Most tokens whose document counts are sent along with tasks.
SENT = 500_000


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """token, df: in how many rows a token stands; counted before anything travels."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def tf_idf(tf: DataFrame, n_docs: DataFrame, key: str, df: DataFrame | None = None) -> DataFrame:
    """Adds df and score = tf * ln(n / df); n_docs has the one column n. df: token, df, sent along if it is small."""
    df = tf.groupBy("token").agg(F.count("*").alias("df")) if df is None else stored(df, "df")
    df = F.broadcast(df) if df.count() <= SENT else df
    return tf.join(df, "token").crossJoin(F.broadcast(n_docs)).withColumn("score", F.col("tf") * F.log(F.col("n").cast("double") / F.col("df")))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that hold a query token. Only query tokens' rows are grouped."""
    listed = docs.select(key, tokens(F.col(text)).alias("words"))
    lengths = listed.select(key, F.size("words").alias("dl"), F.filter("words", lambda w: w.isin(*query)).alias("hits"))
    total = lengths.where("dl is not null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = lengths.select(key, "dl", F.explode("hits").alias("token")).groupBy(key, "dl", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(total)).groupBy(key).agg(F.sum(idf * gain).alias("score"))


def top_tokens(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n best tokens of each key, ties by token."""
    order = W.partitionBy(key).orderBy(F.round("score", 9).desc(), "token")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_tokens(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """key, token, tf, df, score, rank: the n tokens of each key with the highest tf * ln(rows / df), ties by token.

    Document counts of the SENT most frequent tokens are sent along, so their rows stay where their text is and only a key's
    n best of them go on. Rows of the other tokens, each in few texts, travel to their counts."""
    tf, total = term_frequencies(docs, key, text), docs.agg(F.count("*").alias("n"))
    df = stored(document_frequencies(docs, text), "df")
    least = frequent_from(df, SENT)
    often = F.broadcast(df if least is None else df.where(F.col("df") >= least))
    score = (F.col("tf") * F.log(F.col("n").cast("double") / F.col("df"))).alias("score")
    scored = tf.join(often, "token", "left").crossJoin(F.broadcast(total)).select(key, "token", "tf", "n", "df", score)
    if least is None:
        return top_tokens(scored, key, n)
    order = W.partitionBy(key).orderBy(F.round("score", 9).desc_nulls_last(), "token")
    left = stored(scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= n) | F.col("df").isNull()).drop("rank"), "scored")
    rare = left.where("df is null").select(key, "token", "tf", "n").join(df.where(F.col("df") < least), "token").select(key, "token", "tf", "n", "df", score)
    return top_tokens(left.where("df is not null").unionByName(rare), key, n)


def frequent_from(df: DataFrame, most: int) -> int | None:
    """The least count from which on there are at most so many tokens (one more than the greatest if even those are more);
    None if all are."""
    by_count = df.groupBy("df").agg(F.count("*").alias("tokens"))
    cut = by_count.withColumn("upto", F.sum("tokens").over(W.orderBy(F.col("df").desc()).rowsBetween(W.unboundedPreceding, 0)))
    found = cut.agg(F.min(F.when(F.col("upto") <= most, F.col("df"))).alias("least"), F.max("df").alias("top"), F.max("upto").alias("all")).first()
    if (found["all"] or 0) <= most:
        return None
    return found["least"] or found["top"] + 1
