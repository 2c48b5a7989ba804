"""Toxicity by multiple-instance learning: sentences are scored, noisy-or joins them, document labels train them.

A text is a bag of sentences (ended by one of MARKS; of a longer one, every PIECE words). A sentence's score is logistic over
hashed letter n-grams of its words (3 to 5, with word edges); a document's is noisy-or: 1 - prod(1 - score). Only documents
carry labels, so the gradient of the document's likelihood decides which sentences of a toxic document answer for its label,
and every sentence of a clean one is clean. `offending` then names the sentences.

The classifier is fitted on an expected SAMPLE labelled documents, as many of either label, weighed back to the labels'
shares. Of the n-grams those train that part the labels by more than APART standard errors. The sample is dealt into shards of
about SHARD documents, whose weights are averaged.

Only texts and labels of documents whose crc32(doc_id as text) mod 3 is not 1 are learned from.

Defined cases: a null or empty text, or one without letters, scores 0; without learnable documents of both labels all texts
do. A document with several labels is toxic if one of them is 1; rows without doc_id or label teach nothing. Repeated rows
teach once and each get a row; equally for several texts under one doc_id, which all bear its label. A null doc_id is not
held out. A very long text is looked at in slabs that end with a sentence. An empty table gives an empty result; columns
other than doc_id, text and toxic are ignored.
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

from . import common, hashing

#: Characters that end a sentence (fixed values).
MARKS = ".!?\n…。！？"
#: Words of a sentence at most; code points that are looked at together.
PIECE, SLAB = 32, 1 << 18
BITS, ORDERS = 18, (3, 4, 5)
#: Expected number of labelled documents that the classifier is fitted on; documents of a shard.
SAMPLE, SHARD = 8000, 2000
#: Standard errors of the log odds that a trained n-gram has at least, and documents that hold it.
APART, FEWEST = 2.5, 3
STEPS, RATE, L2, BIAS = 250, 0.1, 1e-4, -4.0
TOXIC = 0.7
_POINTS = 0x20000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter (0 if it is none), and whether it ends a sentence."""
    low, marks = np.zeros(_POINTS, np.uint32), np.zeros(_POINTS, bool)
    for i in range(_POINTS):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 else i
    marks[[ord(c) for c in MARKS]] = True
    return low, marks


def slabs(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text and where they begin: up to SLAB code points, up to the last mark among them, else the last blank."""
    a = 0
    while a < len(text):
        part = text[a : a + SLAB]
        if a + SLAB < len(text):
            cut = max(part.rfind(m) for m in MARKS) + 1 or part.rfind(" ") + 1
            part = part[:cut] if cut else part
        yield a, part
        a += len(part)


def instances(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams, the sentence that each belongs to, and where sentences begin and end (from first to last letter)."""
    low, marks = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(points, _POINTS - 1)
    code = np.zeros(len(points) + 2, np.uint64)
    code[1:-1] = low[points]
    letter = code[1:-1] != 0
    begins = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    none = np.zeros(0, np.int64)
    if not len(begins):
        return none, none, none, none
    ends = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
    sentence = np.cumsum(marks[points])[begins]
    new = np.r_[True, sentence[1:] != sentence[:-1]]
    place = np.arange(len(begins))
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    new |= since % PIECE == 0
    of_word = np.cumsum(new) - 1
    owner = np.zeros(len(code), np.int64)
    owner[1:-1][letter] = np.repeat(of_word, ends - begins)
    kept = np.flatnonzero((code != 0) | np.r_[True, code[:-1] != 0])  # one edge mark between words
    code, owner = code[kept], owner[kept]
    h, inner, features, owners = code, np.ones(len(code), bool), [], []
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n > 2:
            inner = inner[: len(code) - n + 1] & (code[n - 2 : len(code) - 1] != 0)  # all but the ends are letters
        if n in ORDERS:
            at = np.flatnonzero(inner)
            features.append((hashing.mixed(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[at + 1])
    first = np.flatnonzero(new)
    return np.concatenate(features), np.concatenate(owners), begins[first], ends[np.r_[first[1:], len(ends)] - 1]


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0

    def sentences(self, text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Logits, begins and ends of the sentences, slab by slab."""
        for at, part in slabs(text or ""):
            feature, owner, begin, end = instances(part)
            if len(begin):
                yield self.bias + np.bincount(owner, self.weights[feature], len(begin)), begin + at, end + at

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(-np.expm1(-sum(_softplus(z).sum() for z, _, _ in self.sentences(text))))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def train(features: list[np.ndarray], owners: list[np.ndarray], bags: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels of bags likeliest; features and owners (sentences within the bag) of each bag,
    its number of sentences, label and weight. Whole-batch Adam steps on the noisy-or likelihood with an L2 penalty."""
    starts = hashing.starts_of(bags)
    feature = np.concatenate(features)
    owner = np.concatenate([o + s for o, s in zip(owners, starts[:-1], strict=True)])
    bag = np.repeat(np.arange(len(bags)), bags)
    share = weights / weights.sum()
    w, first, second = np.r_[np.zeros(n_features), BIAS], np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, STEPS + 1):
        z = w[-1] + np.bincount(owner, w[feature], len(bag))
        none = np.bincount(bag, _softplus(z), len(bags))  # -log of the odds that no sentence is toxic
        pull = np.where(labels == 1, -1 / np.expm1(np.maximum(none, 1e-12)), 1.0) * share
        g = pull[bag] / (1 + np.exp(-z))
        grad = np.r_[np.bincount(feature, g[owner], n_features) + L2 * w[:-1], g.sum()]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w = w - RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    n = np.zeros(2, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            own = np.zeros(1 << BITS, bool)
            for _, part in slabs(text.as_py() or ""):
                own[instances(part)[0]] = True
            seen[toxic] += own
            n[toxic] += 1
    index = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, index].astype(np.int32)), *(pa.array(np.r_[n[k], seen[k][index]]) for k in (0, 1))], ["feature", "clean", "toxic"])
    common.given_back()


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, key of the documents that may be learned from, and doc_id, toxic (0 or 1) of their labels."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((rest != 1) & F.col("text").isNotNull()).withColumn("key", common.row_key("doc_id", "text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where((rest != 1) & F.col("toxic").isNotNull())
    return texts, known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the learnable documents of docs that labels (doc_id, toxic) covers; `sample` bounds their expected number."""
    texts, known = _labelled(docs, labels)
    labelled = common.settled(texts.select("doc_id", "key").join(known, "doc_id").select("key", "toxic").distinct(), "toxic-labels")
    counts = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    unit = F.xxhash64("key", F.lit(41)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    rate = F.when(F.col("toxic") == 1, sample / 2 / counts[1]).otherwise(sample / 2 / counts[0])
    # About `sample` keys, so they are sent to the texts and only those of the sample are shuffled.
    drawn = texts.select("key", "text").join(F.broadcast(labelled.where(unit < rate)), "key").dropDuplicates(["key"])
    drawn = common.settled(drawn.select("key", "toxic", "text"), "toxic-texts")
    found = drawn.select("text", "toxic").mapInArrow(_presence, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= FEWEST).toPandas()
    total = found[found.feature == -1]
    if not len(total) or not total.clean.sum() or not total.toxic.sum():
        return Model()
    n_clean, n_toxic = int(total.clean.sum()), int(total.toxic.sum())
    found = found[found.feature >= 0]
    odds = np.log((found.toxic + 0.5) / (n_toxic + 1)) - np.log((found.clean + 0.5) / (n_clean + 1))
    chosen = np.sort(found.feature[np.abs(odds) / np.sqrt(1 / (found.toxic + 0.5) + 1 / (found.clean + 0.5)) >= APART].to_numpy())
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, features, owners = [], [], []
            for text in batch.column("text"):
                n, feature, owner = 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                for _, part in slabs(text.as_py() or ""):
                    f, o, begin, _ = instances(part)
                    mine = number[f] >= 0
                    feature.append(number[f][mine])
                    owner.append((o[mine] + n).astype(np.int32))
                    n += len(begin)
                sizes.append(n)
                features.append(common.packed(np.concatenate(feature)))
                owners.append(common.packed(np.concatenate(owner)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(sizes, pa.int32()), common.binary_column(features), common.binary_column(owners)], ["key", "toxic", "sentences", "feature", "owner"])
        common.given_back()

    bagged = common.settled(drawn.mapInArrow(bags, "key long, toxic int, sentences int, feature binary, owner binary").where("sentences > 0"), "toxic-bags")
    weight = {0: counts[0] / n_clean, 1: counts[1] / n_toxic}

    def train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        arrays = [[np.frombuffer(x, np.int32) for x in pdf[c]] for c in ("feature", "owner")]
        labels = pdf["toxic"].to_numpy()
        w, bias = train(*arrays, pdf["sentences"].to_numpy(), labels, np.array([weight[k] for k in labels]), len(chosen))
        return pd.DataFrame({"feature": np.arange(-1, len(chosen), dtype=np.int32), "weight": np.r_[bias, w]})

    shards = max(1, round((n_clean + n_toxic) / SHARD))
    parted = bagged.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(43)), F.lit(shards)))
    trained = parted.groupBy("shard").applyInPandas(train_shard, "feature int, weight double").groupBy("feature").agg(F.sort_array(F.collect_list("weight")).alias("w")).toPandas()
    if not len(trained):
        return Model()
    mean = {f: sum(w) / len(w) for f, w in zip(trained.feature, trained.w, strict=True)}
    weights = np.zeros(1 << BITS)
    weights[chosen] = [mean[i] for i in range(len(chosen))]
    return Model(weights, mean[-1])


def scored(docs: DataFrame, model: Model, toxic: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= toxic).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        common.given_back()

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, begin, end (code points, end exclusive), sentence, score: the sentences that score `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begins, ends, said, scores = [], [], [], [], []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                for z, begin, end in model.sentences(text) if model.weights is not None else ():
                    p = np.exp(-np.logaddexp(0.0, -z))
                    for i in np.flatnonzero(p >= least):
                        ids.append(doc)
                        begins.append(int(begin[i]))
                        ends.append(int(end[i]))
                        said.append(text[begin[i] : end[i]])
                        scores.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(said, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "begin", "end", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, begin long, end long, sentence string, score double")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
