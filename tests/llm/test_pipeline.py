"""The pipeline's stages against brute force, each on its own input."""

import sys

import numpy as np

import corpus_pipeline
from rostrum.llm import common

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from oracle import rows as plain  # noqa: E402
from test_lines_and_leaks import brute_leaks, mask  # noqa: E402
from test_minhash import brute as brute_groups  # noqa: E402

import duckdb  # noqa: E402

from rostrum.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "mixing"]
    docs = common.table(spark, SF, "documents")
    after, tables = {}, {}
    for name, stage in stages.items():
        docs = common.settled(stage(spark, docs, SF), name)
        after[name] = docs
        tables[name] = [tuple(r) for r in docs.collect()]
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    original = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    languages, lines, near, clean = (tables[n] for n in list(stages)[:4])
    assert {r[0] for r in languages} == {i for i, t in original.items() if t and any(c.isalpha() for c in t)}
    assert all(original[r[0]] == r[1] for r in languages)
    kept = {r[0]: r[1] for r in lines}
    assert set(kept) <= {r[0] for r in languages}
    for i, t in kept.items():
        left = t.split("\n")
        before = iter(original[i].split("\n"))
        assert all(any(x == y for y in before) for x in left if left != [""])
    gone = {r[0] for r in languages} - set(kept)
    assert all(any(mask(x) for x in original[i].split("\n")) for i in gone)
    groups = {r[0]: r[2] for r in brute_groups([(r[0], r[1]) for r in lines])}
    assert {r[0] for r in near} == {i for i, c in groups.items() if i == c}
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert {r[0] for r in clean} == {d for d, n, bad, _ in brute_leaks([(r[0], r[1]) for r in near], items) if not bad}
    con = duckdb.connect()
    con.register("documents", after["benchmark_decontamination"].toPandas())
    assert plain(after["mixing"].toPandas()) == plain(con.sql(f"SELECT * FROM ({mixing.OP6_SQL}) WHERE taken > 0").df())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def _written(spark, folder, docs, like):
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, `meta.url` string, row string, key long")
    rows.write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        (like(name).limit(0) if not docs else like(name)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables, null texts and sources, repeated rows, and columns whose names hold dots or clash."""
    like = lambda name: common.table(spark, SF, name)
    assert corpus_pipeline.run(spark, _written(spark, tmp_path / "empty", [], like)).count() == 0
    text = lambda i: " ".join("".join(np.random.default_rng(i * 99 + k).choice(list("abdeilmnorstu"), 3 + k % 7)) for k in range(12 + i % 9))
    docs = [(i, text(i), "en", "a" if i % 2 else None, len(text(i)), "u", "r", i) for i in range(40)]
    docs += [(50, None, "en", "a", None, "u", "r", 1), (51, "", None, None, 0, None, None, None), (52, "12 34", "en", "b", 5, "u", "r", 2), docs[3], (None, text(99), None, "b", 1, "u", "r", 3)]
    folder = _written(spark, tmp_path / "odd", docs, like)
    frame = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.settled(stage(spark, frame, folder), name)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "meta.url", "row", "key"]
    assert {r["doc_id"] for r in frame.collect()} == {*range(40), None} and frame.count() == 41
    assert corpus_pipeline.run(spark, folder).count() > 0
