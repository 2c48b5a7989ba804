"""Target-distribution importance resampling: documents are drawn by how much their n-grams look like a target's.

Separators collapse to single spaces (`slabs`); `regex` then scans each text for every n-gram order with overlapping matches between
boundary lookarounds, so that a match's span is an n-gram, and its CRC is counted in a bucket. Buckets of all documents and
all target texts give each bucket a gain, the log ratio of its smoothed shares in thousandths; a document's weight is the
floored mean of its n-grams' gains. Gumbel noise from a digest of the doc_id is added and the highest scores are drawn, which
draws without replacement in proportion to the weights.

A text is scanned once: its buckets are written to the shared folder, and counts and weights are taken from there. Only the
bucket counts reach the driver, BUCKETS numbers a side. Ranks are numbered by ranges of the score, not in one task.

Defined cases: a null or empty text, or one without words, has no n-grams and weight 0; a null doc_id has no digest, so its
score is null and it is neither drawn nor counted for the draw; repeated rows are scored and drawn row by row; an empty target
gives gains by the documents alone; an empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators.order import numbered

from . import common

#: A-Z to lower case, and every other byte that separates words (fixed values) to a space.
ONE_CASE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
SPACES = regex.compile(rb" {2,}")
#: Bytes that are looked at together; a longer text is cut at separators.
SLAB = 1 << 20
ORDERS, BUCKETS = (1, 1), 10_000
#: Fewest words of a document that can be drawn, per cent that are drawn, seed of the noise.
LEAST, PERCENT, SEED = 20, 10, 2024
RESULT = ["doc_id", "n_features", "weight", "score", "rank"]


def ngram_pattern(n: int) -> regex.Pattern:
    """n words between single spaces, from the start of a word to the end of one; without backtracking."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def slabs(text: str | None) -> Iterator[bytes]:
    """Words of a text with single spaces between them, about SLAB bytes at a time."""
    line, a = (text or "").encode("utf-8", "surrogatepass").translate(ONE_CASE), 0
    while a < len(line):
        b = line.find(b" ", a + SLAB)
        b = len(line) if b < 0 else b
        part = SPACES.sub(b" ", line[a:b]).strip(b" ")
        if part:
            yield part
        a = b


def buckets_of(text: str | None, patterns: dict[int, regex.Pattern], buckets: int) -> tuple[int, array]:
    """Number of words, and the bucket of each n-gram; patterns by n. The last n - 1 words of a slab lead the next one."""
    out, n_words, tails = array("I"), 0, dict.fromkeys(patterns, b"")
    for part in slabs(text):
        n_words += part.count(b" ") + 1
        for n, pattern in patterns.items():
            line = tails[n] + b" " + part if tails[n] else part
            out.extend(crc32(m[0]) % buckets for m in pattern.finditer(line, overlapped=True))
            tails[n] = b" ".join(line.rsplit(b" ", n - 1)[-(n - 1) :]) if n > 1 else b""
    return n_words, out


def scanned(docs: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, key: str | None = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, buckets (packed numbers of 2 bytes, or 4 where there are more); written once."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {n: ngram_pattern(n) for n in range(orders[0], orders[1] + 1)}
        for batch in batches:
            found = [buckets_of(t.as_py(), patterns, buckets) for t in batch.column("text")]
            packed = common.binary_column([common.packed(np.array(b, kind)) for _, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), packed], ["doc_id", "n_words", "n_features", "buckets"])
        common.given_back()

    own = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return common.settled(docs.select(own.alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary"), "ngram-buckets")


def _unpacked(column: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint16 if buckets <= 1 << 16 else np.uint32)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket stands in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in _unpacked(batch.column("buckets"), buckets):
                seen += np.bincount(own, minlength=buckets)
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.array(seen[index])], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, with one more in each bucket."""
    n = len(documents)
    up, down = (target + 1.0) * (documents.sum() + float(n)), (documents + 1.0) * (target.sum() + float(n))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[own].sum()) // len(own) if len(own) else 0 for own in _unpacked(batch.column("buckets"), len(gain))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_words", "n_features")] + [pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: str = "doc_id", seed: int = SEED):
    """Thousandths of Gumbel noise from the first 32 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null for what isn't drawn."""
    rows = scanned(docs, orders, buckets)
    aim = bucket_counts(scanned(target, orders, buckets, None), buckets)
    scored = weighed(rows, gains(bucket_counts(rows, buckets), aim)).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = common.settled(scored.withColumn("able", (F.col("n_words") >= least) & F.col("doc_id").isNotNull()), "scores")
    n = scored.where("able").count()
    placed = numbered(scored.where("able").withColumn("low", -F.col("score")), ["low", "doc_id"])
    ranked = placed.withColumn("rank", F.when(F.col("n") < percent * n // 100, F.col("n").cast("long") + 1)).select(*RESULT)
    return ranked.unionByName(scored.where("not able").withColumn("rank", F.lit(None).cast("long")).select(*RESULT))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns, once for each drawn row of their doc_id, and their rank."""
    ranks = resampled(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("__id"), F.col("rank").alias("__rank"))
    one = docs.dropDuplicates(["doc_id"])
    return one.join(ranks, one["doc_id"] == ranks["__id"]).select(*[one[f"`{c}`"] for c in one.columns], F.col("__rank").alias("draw_rank"))


#: CRC-32 a byte at a time with a table of 256 derived by shifts, once for each distinct word.
OP13_SQL = r"""WITH RECURSIVE shifts AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM shifts WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM shifts WHERE k = 8),
said AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents UNION ALL
SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
octets AS (SELECT word, list_transform(range(CAST(len(hex(encode(word))) // 2 AS BIGINT)), lambda i: 16 * (strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(word)), 2 * i + 2, 1)) - 1) AS b FROM (SELECT DISTINCT word FROM said)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INT) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM octets, crc_table),
grams AS (SELECT side, doc_id, bucket, count(*) AS n FROM said JOIN hashed USING (word) GROUP BY ALL),
sizes AS (SELECT CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS big, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS small FROM grams),
shares AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS t FROM grams GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (big + 10000) / ((s + 1) * (small + 10000)))) AS gain FROM shares, sizes),
weighed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM grams JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
digest AS (SELECT doc_id, sha256(concat('2024:', CAST(doc_id AS VARCHAR))) AS x FROM documents),
drawn AS (SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(x, i + 1, 1)) - 1 AS BIGINT))), lambda a, y: a * 16 + y) AS h FROM digest),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM drawn d LEFT JOIN weighed w ON w.doc_id = d.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM placed"""


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
