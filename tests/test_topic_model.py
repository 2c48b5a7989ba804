"""What a topic model reads and shuffles."""

from pyspark.sql import functions as F

from rostrum.operators import topic_model as tm

WORDS = [["tax", "budget", "money"], ["school", "teacher", "class"], ["farm", "wheat", "field"]]


def texts(spark):
    rows = [(i, " ".join(WORDS[i % 3][(i + j) % 3] for j in range(4 + i % 5))) for i in range(60)] + [(60, None), (61, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_texts_are_taken_apart_once(spark):
    """Topics, sizes and words come from stored tokens."""
    found = tm.topics_of(texts(spark), "doc_id", "text", 3)
    assert found.count() == 62 and "regexp_extract_all" not in plan(found)


def test_rows_do_not_travel_to_their_topic(spark):
    """A few topics hold all documents, so tables with a row for each topic are sent to them, whatever their guessed size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = texts(spark)
        rows = tm.transform(tm.fit(docs, "text", 3, 64), docs, "text")
        found = tm.representatives(rows, "doc_id")
        assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["topic_id"] for r in got} == {r["topic_id"] for r in rows.where("topic_id >= 0").select("topic_id").distinct().collect()}
    assert rows.agg(F.count("*")).first()[0] == 62 and {r["rank"] for r in got} == {1, 2, 3}


def test_tokens_are_hashed_once(spark, monkeypatch):
    """The fit and the assignment read stored counts, and what topics need is stored, not the features."""
    hashed, kept = [], []
    transform, stored = tm.HashingTF._transform, tm.stored
    monkeypatch.setattr(tm.HashingTF, "_transform", lambda self, rows: hashed.append(1) or transform(self, rows))
    monkeypatch.setattr(tm, "stored", lambda df, *a: kept.append(df.columns) or stored(df, *a))
    found = tm.topics_of(texts(spark), "doc_id", "text", 3)
    assert len(hashed) == 1 and kept == [["doc_id", "tokens", "tf"], ["doc_id", "tokens", "topic_id"]]
    own = {r["doc_id"]: (r["topic_id"], r["name"]) for r in found.collect()}
    docs = texts(spark)
    again = tm.transform(tm.fit(docs, "text", 3), docs, "text")
    assert {k: t for k, (t, _) in own.items()} == {r["doc_id"]: r["topic_id"] for r in again.collect()}


def test_class_words_are_counted_once(spark):
    rows = texts(spark).select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    assert "Generate" not in plan(tm.class_tf_idf(rows, "doc_id"))
