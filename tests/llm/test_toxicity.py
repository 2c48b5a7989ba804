"""Toxicity: held-out accuracy, the noisy-or gradient, sentences against a plain version, and the defined cases."""

import re
import tracemalloc
import zlib

import numpy as np
import pytest

from rostrum.llm import toxicity as tx

SCHEMA = "doc_id long, text string, toxic string, score int, `meta.url` string"
CLEAN, BAD = ["ran", "tale", "moss", "grim", "lend", "pose", "ruin", "silt", "vane", "wilt"], ["krungol", "krungat", "zorphen"]


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    docs, labels, planted = [], [], {}
    for i in range(n):
        lines = [" ".join(rng.choice(CLEAN, int(rng.integers(3, 12)))) for _ in range(int(rng.integers(1, 30)))]
        bad = i % 4 == 0
        if bad:
            at = int(rng.integers(len(lines)))
            lines[at] += " " + str(rng.choice(BAD))
            planted[i] = lines[at]
        docs.append((i, ". ".join(lines), "x", 1, "u"))
        labels.append((i, int(bad)))
    return docs, labels, planted


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels, planted = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    return tx.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int")), frame, planted


def test_documents_and_sentences(spark, learned):
    model, frame, planted = learned
    got = {r["doc_id"]: r for r in tx.scored(frame, model).collect()}
    assert len(got) == 400 and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) == (i in planted) for i, r in got.items())
    named = [(r["doc_id"], r["sentence"]) for r in tx.offending(frame, model).collect()]
    assert sorted(named) == sorted(planted.items())
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert all(text[r["doc_id"]][r["begin"] : r["end"]] == r["sentence"] for r in tx.offending(frame, model).collect())


def test_held_out_rows_teach_nothing(spark, learned):
    docs, labels, _ = corpus()
    other = [(i, 1 - t if held(i) else t) for i, t in labels]
    again = tx.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(other + [(None, 1)], "doc_id long, toxic int"))
    assert np.array_equal(again.weights, learned[0].weights) and again.bias == learned[0].bias


def test_real_table(spark):
    d = "/root/testdata/sf0.1"
    got = tx.op12_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 1000 and (got.predicted == got.toxic).mean() > 0.97  # some labels of this table have no cause in the text
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.995
    assert got[got.toxic == 1].score.median() > 0.9 > 0.1 > got[got.toxic == 0].score.median()


def plain_sentences(text):
    out = []
    for part in re.split("[" + re.escape(tx.MARKS) + "]", text):
        words = re.findall(r"[^\W\d_]+", part)
        out += [words[i : i + tx.PIECE] for i in range(0, len(words), tx.PIECE)]
    return out


def test_instances(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abÉß ı.!?\n7_-。"), 4000)) + " a" * 100
    monkeypatch.setattr(tx, "PIECE", 5)
    feature, owner, begin, end = tx.instances(text)
    want = plain_sentences(text)
    assert len(begin) == len(want) and [re.findall(r"[^\W\d_]+", text[a:b]) for a, b in zip(begin, end)] == want
    counts = [sum(max(0, len(w) + 2 - n + 1) for n in tx.ORDERS for w in words) for words in want]
    assert np.bincount(owner, minlength=len(want)).tolist() == counts
    same = tx.instances("one Word.two word")
    assert set(same[0][same[1] == 0]) & set(same[0][same[1] == 1]) >= set(tx.instances("word")[0])


def test_gradient():
    """Training lowers the noisy-or loss and finds the sentence that alone sets toxic bags apart."""
    rng = np.random.default_rng(2)
    features, owners, bags, labels = [], [], [], []
    for i in range(60):
        n = int(rng.integers(2, 6))
        f, o = rng.integers(1, 6, 3 * n), np.repeat(np.arange(n), 3)
        if i % 2:
            f, o = np.r_[f, 0], np.r_[o, int(rng.integers(n))]
        features.append(f), owners.append(o), bags.append(n), labels.append(i % 2)
    w, bias = tx.train(features, owners, np.array(bags), np.array(labels), np.ones(60), 6)
    assert w[0] + bias > 2 and all(bias + 3 * x < -1.5 for x in w[1:])


def test_slabs(monkeypatch):
    text = "one two. three four! " * 50 + "five " * 100 + "x" * 300
    monkeypatch.setattr(tx, "SLAB", 64)
    parts = list(tx.slabs(text))
    assert "".join(p for _, p in parts) == text and all(text[a : a + len(p)] == p and len(p) <= 64 for a, p in parts)


def test_defined_cases(spark, learned):
    model = learned[0]
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "ran krungol"), (4, "ran krungol"), (None, "ran krungol"), (5, "ran moss. " * 3)]
    frame = spark.createDataFrame([(i, t, "x", 1, "u") for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["predicted"], r["score"] == 0) for r in tx.scored(frame, model).collect())
    assert got == [(0, 1, False), (1, 0, True), (2, 0, True), (3, 0, True), (4, 1, False), (4, 1, False), (5, 0, False)]
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for docs, known in ((frame, labels), (frame.limit(0), labels), (frame, labels.limit(0))):
        empty = tx.fit(docs, known)
        assert empty.weights is None and tx.scored(docs, empty).where("score <> 0 or predicted <> 0").count() == 0
        assert tx.offending(docs, empty).count() == 0


def test_very_long_text():
    model = tx.Model(np.zeros(1 << tx.BITS), -20.0)
    model.weights[tx.instances("krungol")[0]] = 10.0
    tx._tables()
    text = "ran moss tale " * 700_000 + "krungol"
    tracemalloc.start()
    assert model.score(text) > 0.99
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
