"""HyperMinHash near-duplicate detection on five-word shingles.

Each text's shingle hashes pass 128 hash functions; a register keeps the leading-zero count of the least value and the
mantissa bits after it (6 + 10 bits). Documents with the same shingle set form a class and travel on as one row. Bands of
four registers bring classes together; a band's bucket holds each member against its most central one, and after those
links are verified and joined to components, members of buckets that still span components are joined across components
by the rare beginnings of their sets.
Candidate pairs are first held against the collision-corrected Jaccard estimate (the margin below the threshold is five
standard errors), then against the full sets, which alone decide.

A link at similarity 0.75 shares no band with odds of 5e-6, and is under the estimate's margin with odds of 1e-6.

Defined cases: a text without words, or a null text, has an empty set and links with nothing, so its component is its own
doc_id; a null doc_id never names a component that has another; repeated rows share a component; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

U = np.uint64
WORDS = 5
#: Intersection and union parts of the threshold: 100 * intersection >= 75 * union.
PERCENT = 75
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: Shingles that are hashed together; bytes of sets that a batch of rows holds.
SLICE, SET_BYTES = 1 << 17, 4 << 20
#: Odds that two registers of unrelated sets agree: about 2 ** -MANTISSA times 1.4 for like sizes; measured on pairs of
#: disjoint sets.
COLLISION = 1.4 / (1 << MANTISSA)
#: Five standard errors of the estimate at the threshold.
MARGIN = 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
_MULTIPLY = (np.random.default_rng(104).integers(0, 1 << 62, REGISTERS, dtype=np.uint64) << U(1)) | U(1)
_FLIP = np.random.default_rng(105).integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one document after the other, and where each begins (n + 1)."""
    names, _, _, firsts = hashing.words(data, offsets, lower=True)
    n = np.diff(firsts)
    many = np.maximum(n - WORDS + 1, 0)
    windows = hashing.window_hashes(names, WORDS)
    if len(n) == 1 and len(windows):  # one long text
        value = np.unique(windows)
        return value, np.array([0, len(value)])
    whole = windows[hashing.ranges(firsts[:-1], many)]
    doc = np.repeat(np.arange(len(n)), many)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = np.array([_fold(names[firsts[i] : firsts[i + 1]]) for i in few], np.uint64)
    value, doc = np.r_[whole, short], np.r_[doc, few]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _fold(names: np.ndarray) -> np.uint64:
    h = np.array([len(names)], np.uint64)
    for x in names:
        h = hashing.mixed(h * _MULTIPLY[:1] + x)
    return h[0]


def registers(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, a row of REGISTERS 16-bit numbers for each non-empty range of value."""
    least = np.full((REGISTERS, len(starts)), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(value), SLICE):  # a slice of the values, and the ranges that have part in it
        part = value[at : at + SLICE]
        a, b = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(part))
        begins = np.maximum(starts[a:b] - at, 0)
        for k in range(REGISTERS):
            np.minimum(least[k, a:b], np.minimum.reduceat((part ^ _FLIP[k]) * _MULTIPLY[k], begins), out=least[k, a:b])
    return np.stack([compressed(x) for x in least], axis=1)


def compressed(x: np.ndarray) -> np.ndarray:
    """Leading zeros (0 to 63) in the high 6 bits, the MANTISSA bits after the leading one in the low."""
    x = np.maximum(x, U(1))
    zeros = np.zeros(len(x), np.uint64)
    y = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = y < (U(1) << U(64 - step))
        zeros[low] += U(step)
        y[low] <<= U(step)
    return ((zeros << U(MANTISSA)) | (y << U(1) >> U(64 - MANTISSA))).astype(np.uint16)


SKETCH = "key long, n_shingles long, class long, sketch binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = common.text_buffers(batch.column("text"))
        counts, classes, sketches = [], [], []
        for a, b in common.chunks(offsets):
            value, firsts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.diff(firsts)
            some = np.flatnonzero(n)
            own = np.zeros(b - a, np.int64)
            made: list[bytes | None] = [None] * (b - a)
            if len(some):
                sums = np.add.reduceat(hashing.mixed(value), firsts[some]) * U(3) + np.bitwise_xor.reduceat(hashing.mixed(value + U(1)), firsts[some])
                own[some] = hashing.mixed(sums + n[some].astype(np.uint64)).astype(np.int64)
                for i, row in zip(some.tolist(), registers(value, firsts[some]), strict=True):
                    made[i] = row.tobytes()
            counts.append(n)
            classes.append(own)
            sketches += made
        if sketches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.concatenate(counts)), pa.array(np.concatenate(classes)), pa.array(sketches, pa.binary())], ["key", "n_shingles", "class", "sketch"])
    common.given_back()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int64).reshape(-1, BANDS)
        own = batch.column("class").to_numpy()
        # The bucket's name also holds the band's number, so that buckets of different bands stay apart.
        bucket = hashing.mixed(rows.astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLY[0]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(np.repeat(own, BANDS)), pa.array(np.repeat(batch.column("n").to_numpy(), BANDS))], ["bucket", "class", "n"])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    agree = (a == b).mean(axis=1)
    return (agree - COLLISION) / (1 - COLLISION)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_u", "sketch_v"))
        yield batch.select(["u", "v"]).filter(pa.array(estimate(a, b) >= PERCENT / 100 - MARGIN))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = common.text_buffers(batch.column("text"))
        blobs, size, at = [], 0, 0
        for a, b in common.chunks(offsets):
            value, firsts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            blobs += [common.packed(value[i:j]) for i, j in zip(firsts[:-1], firsts[1:], strict=True)]
            size += value.nbytes
            if size > SET_BYTES or b == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("class")[at:b], common.binary_column(blobs)], ["class", "set"])
                blobs, size, at = [], 0, b
    common.given_back()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, found in zip(batch.column("class").to_pylist(), batch.column("set"), strict=True):
            token = np.frombuffer(found.as_buffer(), np.int64)
            for i in range(0, len(token), 500_000):
                yield token[i : i + 500_000], own


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, token: a row for each member of the sets."""
    tokens, owns, size = [], [], 0
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(owns, np.int64), [len(x) for x in tokens])), pa.array(np.concatenate(tokens))], ["class", "token"])
    for token, own in _tokens(batches):
        tokens.append(token)
        owns.append(own)
        size += len(token)
        if size > 200_000:
            yield rows()
            tokens, owns, size = [], [], 0
    if tokens:
        yield rows()
    common.given_back()


def linked(a: bytes | pa.Buffer, b: bytes | pa.Buffer) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    common.given_back()


class Classes:
    """Classes of documents with equal shingle sets, their sketches and, on demand, their sets."""

    def __init__(self, docs: DataFrame):
        self.own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", common.row_key("doc_id", "text"))
        self.sketched = common.settled(self.own.select("key", "text").mapInArrow(_sketches, SKETCH), "sketches")
        self.classes = common.settled(self.sketched.where("n_shingles > 0").groupBy("class").agg(F.min_by("sketch", "key").alias("sketch"), F.min("key").alias("key"), F.first("n_shingles").alias("n")), "classes")

    def sets(self, asked: DataFrame) -> DataFrame:
        """class, set (sorted shingle hashes) of the asked classes."""
        keys = self.classes.join(asked, "class", "left_semi").select("key", "class")
        texts = self.own.join(keys, "key")
        return common.settled(texts.select("class", "text").mapInArrow(_sets, "class long, set binary").dropDuplicates(["class"]), "sets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs u > v whose estimate is near the threshold or above."""
        sketch = self.classes.select("class", "sketch")
        both = pairs.join(sketch.toDF("u", "sketch_u"), "u").join(sketch.toDF("v", "sketch_v"), "v")
        return both.mapInArrow(_likely, "u long, v long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold. Only classes in a pair have their sets made."""
        pairs = common.settled(self.likely(pairs), "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct())
        both = pairs.join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v")
        return common.settled(both.mapInArrow(_confirm, "u long, v long"), "links")


def _able(n_u: str, n_v: str):
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(n_u, n_v) >= PERCENT * F.greatest(n_u, n_v)


def _pairs(rows: DataFrame, n_u: str = "n_u", n_v: str = "n_v") -> DataFrame:
    return rows.where(_able(n_u, n_v)).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def _prefix_pairs(classes: Classes, torn: DataFrame) -> DataFrame:
    """u > v of different components among the torn classes (class, root, n): all pairs that can reach the threshold.

    With shingles in one order, rarest first, two sets that reach it share a shingle among the first n - 0.75 n + 1 of
    each. At the first one they share, what is left of either set bounds what both can share; pairs under the needed
    overlap are not made. Edits make rare shingles, so copies that differ too much share none this early."""
    tokens = classes.sets(torn.select("class")).mapInArrow(_token_rows, "class long, token long")
    common_ = tokens.groupBy("token").agg(F.count("*").alias("df"))
    order = W.partitionBy("class").orderBy("df", "token")
    ranked = tokens.join(common_, "token").withColumn("at", F.row_number().over(order) - 1).where("df > 1")
    first = ranked.join(torn, "class").where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100))
    first = common.settled(first.select("token", "class", "root", "n", "at"), "prefixes")
    shared = first.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    first = common.settled(first.join(shared, "token", "left_semi"), "shared-prefixes")
    side = lambda x, k: first.select("token", F.col("class").alias(x), F.col("root").alias(f"root_{k}"), F.col("n").alias(f"n_{k}"), (F.col("n") - F.col("at")).alias(f"left_{k}"))
    able = F.least("left_u", "left_v") * (100 + PERCENT) >= PERCENT * (F.col("n_u") + F.col("n_v"))
    return _pairs(side("a", "u").join(side("b", "v"), "token").where((F.col("root_u") < F.col("root_v")) & _able("n_u", "n_v") & able))


def rooted(classes: Classes) -> DataFrame:
    """class, root: the least class that verified links reach.

    A bucket's members are first held against its most central one, the member with the most company over all its
    buckets: the text that a group's near copies were made from has more of it than any copy, and mostly links them all.
    Members of buckets that still hold several components after that are joined exactly, across components, by prefixes
    of their sets (`_prefix_pairs`)."""
    bands = classes.classes.select("class", "sketch", "n").mapInArrow(_bands, "bucket long, class long, n long")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("company")).where("company > 1")
    members = common.settled(bands.join(shared, "bucket"), "buckets")
    central = members.groupBy("class").agg(F.sum("company").alias("weight"))
    members = common.settled(members.join(central, "class").select("bucket", "class", "n", "weight"), "members")
    lead = members.groupBy("bucket").agg(F.max(F.struct("weight", "class", "n")).alias("lead")).select("bucket", F.col("lead.class").alias("b"), F.col("lead.n").alias("n_v"))
    star = common.settled(_pairs(members.join(common.settled(lead, "leads"), "bucket").select(F.col("class").alias("a"), "b", F.col("n").alias("n_u"), "n_v")), "star")
    roots = common.settled(_rooted(classes.classes.select("class"), components(classes.confirmed(star))), "roots")
    placed = common.settled(members.select("bucket", "class", "n").join(roots, "class"), "rooted")
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    torn = common.settled(placed.join(several, "bucket", "left_semi"), "torn")
    across = _prefix_pairs(classes, common.settled(torn.select("class", "root", "n").distinct(), "torn-classes"))
    found = classes.confirmed(across.join(star, ["u", "v"], "left_anti"))
    ends = found.join(roots.toDF("u", "root_u"), "u").join(roots.toDF("v", "root_v"), "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    higher = components(ends).select(F.col("node").alias("class"), F.col("root").alias("top"))
    return roots.join(higher.withColumnRenamed("class", "root"), "root", "left").select("class", F.coalesce("top", "root").alias("root"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, class, root for each row; root names its component (null for an empty set)."""
    classes = Classes(docs)
    roots = common.settled(rooted(classes), "components")
    rows = classes.own.select("doc_id", "key").join(classes.sketched.select("key", "n_shingles", "class").distinct(), "key")
    return rows.join(roots, "class", "left").select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = common.settled(placed(docs), "placed")
    named = common.settled(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    out = rows.where("root is not null").join(named, "root").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; documents with empty sets stay. Rows that
    are equal in doc_id and text collapse to one. All columns stay."""
    rows = placed(docs)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    keep = first.select(F.col("best.key").alias("__row_key")).union(rows.where("root is null").select(F.col("key").alias("__row_key")).distinct())
    keep = common.settled(keep, "representatives")
    own = common.row_key(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    keyed = docs.select(own.alias("key"), F.struct(*common.quoted(docs.columns)).alias("row"))
    kept = keyed.join(keep.withColumnRenamed("__row_key", "key"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
