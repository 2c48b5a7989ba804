"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of lower-cased letters (1 to 3, with word edges), weighted by TF-IDF with document
frequencies over all training documents, and scaled to unit length. The weights are trained with the
follow-the-regularised-leader method and an elastic-net penalty on a bounded, language-balanced sample that is split
into shards whose weights are averaged; a temperature is then fitted on sampled training documents kept out of the fit.

Only text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0 are learned from.

Defined cases: a null text, or one without letters, is `und` with score 0, as is every text when nothing can be learned;
a null doc_id is neither held out nor learned from; repeated rows each get a row; an empty table gives an empty result;
columns other than doc_id, text and lang are ignored. Any number of languages may stand in the table; those that the sample
drew can be predicted, and with more than WIDE of them n-grams share features, so that the weights keep their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 16
ORDERS = 3
#: Code points of a text that are looked at together.
SEGMENT = 1 << 18
#: Most languages that the weights hold at the full number of features; most rows of a table that is sent along with tasks.
WIDE, SENT = 256, 10_000
UND = "und"
#: Expected number of sampled training documents over all languages, and the part of them that fits the temperature.
SAMPLE, CALIBRATION, SHARDS, EPOCHS = 6000, 0.2, 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x33480)), bool, 0x33480)


def segments(text: str) -> Iterator[str]:
    """Parts of a text of up to SEGMENT code points, which end with a blank where there is one: so case depends on no other
    part. A line end stands before and after the text."""
    a = 0
    while a < len(text):
        b = a + SEGMENT
        if b < len(text):
            b = text.rfind(" ", a, b) + 1 or b
        yield "\n" * (a == 0) + text[a:b] + "\n" * (b >= len(text))
        a = b


def features(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, one for each place, a segment of the text at a time; nothing if it has no letters. The last
    codes of a segment lead the next one, so segments change no n-gram."""
    tail, before = np.zeros(0, np.uint64), np.uint64(1)
    for part in segments(text or ""):
        points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(_letters()[np.minimum(points, 0x33480 - 1)], points, 0).astype(np.uint64)
        kept = code[(code != 0) | (np.r_[before, code[:-1]] != 0)]  # one edge mark between words
        before = code[-1]
        line = np.r_[tail, kept]
        for n in range(ORDERS):
            new = line[max(0, len(tail) - n) :]  # n codes of what was seen, so that each n-gram comes once
            if len(new) > n:
                h = new[: len(new) - n].copy()
                some = h != 0
                for k in range(1, n + 1):
                    nxt = new[k : len(new) - n + k]
                    h = h * np.uint64(0x100000001B3) + nxt
                    some |= nxt != 0
                yield ((h[some] * _ODD[n]) >> np.uint64(64 - bits)).astype(np.int64)
        tail = line[-(ORDERS - 1) :]


def counts_of(text: str | None, bits: int = BITS) -> np.ndarray:
    """How often each hashed n-gram stands in a text."""
    out, waiting, size = np.zeros(1 << bits, np.int64), [], 0
    for found in features(text, bits):
        waiting.append(found)
        size += len(found)
        if size > SEGMENT:
            out += np.bincount(np.concatenate(waiting), minlength=1 << bits)
            waiting, size = [], 0
    return out + np.bincount(np.concatenate(waiting), minlength=1 << bits) if waiting else out


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's TF-IDF vector of length 1 (1 + log of counts)."""
    counts = counts_of(text, len(idf).bit_length() - 1)
    index = np.flatnonzero(counts)
    if not len(index):
        return index, np.zeros(0)
    value = (1 + np.log(counts[index])) * idf[index]
    norm = np.sqrt(value @ value)
    return index, value / (norm or 1.0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        index, value = vector(text, self.idf)
        return value @ self.weights[index] if len(index) else None


def _doc_frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += counts_of(text.as_py(), bits) > 0
                n += 1
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, index].astype(np.int32)), pa.array(np.r_[n, seen[index]])], ["feature", "df"])
        common.given_back()

    return run


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, n_features: int = 1 << BITS) -> np.ndarray:
    z, n = np.zeros((n_features, n_langs)), np.zeros((n_features, n_langs))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for index, value, lang in examples:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = value @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[lang] -= 1
            g = np.outer(value, p)
            more = ni + g * g
            z[index] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[index] = more
    return weights(z, n)


def best_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), truth]))

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the training documents of docs. `sample` bounds the expected number of documents the weights are fitted
    on; document frequencies cover all."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = docs.select("doc_id", "text", "lang").where((rest != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = common.settled(train.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n_langs = counts.count()
    if not n_langs:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)))
    unit = (F.xxhash64("doc_id", F.lit(29)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
    labelled = train.withColumn("unit", unit).join(F.broadcast(counts) if n_langs <= SENT else counts, "lang")
    drawn = labelled.where(F.col("unit") < F.least(F.lit(1.0), F.lit(sample / n_langs) / F.col("n"))).select(F.xxhash64("doc_id", F.lit(31)).alias("own"), "lang", "text")
    drawn = common.settled(drawn, "langid-texts")
    langs = sorted(r["lang"] for r in drawn.select("lang").distinct().collect())
    number, n_langs = {k: i for i, k in enumerate(langs)}, len(langs)
    if not langs:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)))
    bits = max(8, BITS - max(0, (n_langs - 1).bit_length() - (WIDE - 1).bit_length()))
    df = train.select("text").mapInArrow(_doc_frequencies(bits), "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    idf, n = np.zeros(1 << bits), max(1, int(df.loc[df.feature == -1, "df"].sum()))
    df = df[df.feature >= 0]
    idf[df.feature] = np.log((1 + n) / (1 + df.df)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t.as_py(), idf) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array([number[x] for x in batch.column("lang").to_pylist()], pa.int32()), pa.array([common.packed(i.astype(np.int32)) for i, _ in made], pa.binary()), pa.array([common.packed(v) for _, v in made], pa.binary())],
                ["own", "lang", "index", "value"],
            )
        common.given_back()

    vectored = common.settled(drawn.mapInArrow(vectors, "own long, lang int, index binary, value binary"), "langid-sample")
    kept_out = F.pmod(F.col("own"), F.lit(1000)) < int(CALIBRATION * 1000)

    def train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "lang"])
        examples = [(np.frombuffer(i, np.int32), np.frombuffer(v), int(k)) for i, v, k in zip(pdf["index"], pdf["value"], pdf["lang"], strict=True) if len(i)]
        w = ftrl(examples, n_langs, 1 << bits)
        feature, lang = np.nonzero(w)
        return pd.DataFrame({"feature": feature.astype(np.int32), "lang": lang.astype(np.int32), "weight": w[feature, lang], "n": 1})

    fitted = vectored.where(~kept_out).withColumn("shard", F.pmod(F.xxhash64("own"), F.lit(SHARDS)))
    shards = max(1, fitted.select("shard").distinct().count())
    found = fitted.groupBy("shard").applyInPandas(train_shard, "feature int, lang int, weight double, n int").groupBy("feature", "lang").agg(F.sort_array(F.collect_list("weight")).alias("w")).toPandas()
    weights = np.zeros((1 << bits, n_langs))
    if len(found):
        weights[found.feature, found.lang] = [sum(w) / shards for w in found.w]
    model = Model(langs, idf, weights)

    def logits(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(v) @ weights[np.frombuffer(i, np.int32)] for i, v in zip(pdf["index"], pdf["value"], strict=True)]
        return pd.DataFrame({"own": pdf["own"], "lang": pdf["lang"], "logits": [r.tolist() for r in rows]})

    held = vectored.where(kept_out & (F.length("index") > 0)).mapInPandas(lambda it: map(logits, it), "own long, lang int, logits array<double>").orderBy("own", "lang").toPandas()
    if len(held) and n_langs > 1:
        model.temperature = best_temperature(np.array(held.logits.tolist()), held.lang.to_numpy())
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns that docs has beside text stay out: doc_id, held_out, lang_pred, score."""
    langs, scale = model.langs, model.temperature

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score = [], []
            for text in batch.column("text"):
                x = model.logits(text.as_py()) if langs else None
                if x is None:
                    said.append(UND)
                    score.append(0.0)
                else:
                    p = np.exp((x - x.max()) / scale)
                    k = int(p.argmax())
                    said.append(langs[k])
                    score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        common.given_back()

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(batches_of, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows that are `und` or whose score is under `least`; the columns stay as they are."""
    langs, scale = model.langs, model.temperature

    def keep(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            x = model.logits(text) if langs else None
            out.append(x is not None and 1 / np.exp((x - x.max()) / scale).sum() >= least)
        return pd.Series(out, dtype=bool)

    return docs.where(F.pandas_udf(keep, "boolean")("text"))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
