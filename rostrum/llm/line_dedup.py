r"""Line deduplication by a log-template tree.

Lines are split into tokens; tokens that hold a digit are variable fields and become `<*>`. The tree has a fixed depth: a
line goes to the leaf of its token count and its first three tokens. A leaf whose lines agree at all but a fifth of the
places becomes one template, with `<*>` where they differ; any other leaf is parted by the place with the fewest distinct
tokens (the first of such), and its parts again, until a part agrees or is a single masked line. A template that occurs in at least `min_docs` documents is dropped everywhere but in the document with the smallest doc_id.
Tasks parse lines and send names (64-bit hashes) of leaves and masked lines; Spark counts, joins and decides.

Lines of fewer than `MIN_TOKENS` tokens, and lines of which less than half the tokens are free of digits (rows of tables),
have no variable fields: only the same tokens in `min_docs` documents drop them.

Lines end at \n; blank lines and lines under `min_tokens` tokens have no template and stay; op2 and the pipeline give
every line of a token or more one. Defined cases: a null text
stays null; a null doc_id counts as larger than any other; repeated rows count as documents of their own and lose or keep
lines alike; an empty table gives an empty result; columns other than doc_id and text pass through `dedup_lines`
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_DOCS, MIN_TOKENS, LEAD, VARIABLE, FIXED = 5, 3, 3, 0.2, 0.5
#: Most leaves (8 bytes each) that are sent along with tasks; most tokens of a part that one task parts further.
SMALL, PART = 500_000, 1_000_000
#: Tokens that a task collects before it sends them.
FLUSH = 1 << 17
_DIGIT = re.compile(rb"[0-9]")
LINES = "doc_id long, doc long, leaf long, own long"
TOKENS = "part long, own long, tokens array<long>"
AGREED = "own long, template long"
EDITED = T.StructType([T.StructField("text", T.StringType()), T.StructField("lost", T.LongType())])


def masked(line: bytes) -> list[bytes]:
    """A line's tokens, variable fields as `<*>` where enough others are left. bytes.split() parts at the code points that separate words here."""
    tokens = line.split()
    if len(tokens) >= MIN_TOKENS and _DIGIT.search(line):
        some = [b"<*>" if _DIGIT.search(t) else t for t in tokens]
        return some if some.count(b"<*>") <= (1 - FIXED) * len(some) else tokens
    return tokens


def _name(data: bytes) -> int:
    x = xxhash.xxh64_intdigest(data, 42)
    return x - (1 << 64) if x >> 63 else x


def own_of(tokens: list[bytes]) -> int:
    return _name(b" ".join(tokens))


def leaf_of(tokens: list[bytes]) -> int:
    return _name(b"%d " % len(tokens) + b" ".join(tokens[:LEAD]))


def _parsed(min_tokens: int):
    """doc_id, doc, leaf, own: distinct masked lines of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves, owns = [], [], []
            for k, text in enumerate(batch.column("text")):
                if not text.is_valid:
                    continue
                found = {}
                for line in text.as_buffer().to_pybytes().split(b"\n"):
                    tokens = masked(line)
                    if tokens and len(tokens) >= min_tokens:
                        found[own_of(tokens)] = leaf_of(tokens)
                rows += [k] * len(found)
                owns += found.keys()
                leaves += found.values()
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("doc").take(rows), pa.array(leaves, pa.int64()), pa.array(owns, pa.int64())], ["doc_id", "doc", "leaf", "own"])
        common.given_back()

    return run


def _tokens(wanted: np.ndarray | None):
    """part, own, tokens: lines in the wanted leaves (sorted), or in all leaves, that are long enough for a variable
    place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, rows, size = set(), [], 0
            for text in batch.column("text"):
                for line in text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else ():
                    tokens = masked(line)
                    if int(len(tokens) * VARIABLE) < 1 or _DIGIT.search(line) and b"<*>" not in tokens:
                        continue
                    leaf = leaf_of(tokens)
                    if wanted is not None and not _holds(wanted, leaf):
                        continue
                    own = own_of(tokens)
                    if own not in seen:
                        seen.add(own)
                        rows.append((leaf, own, np.fromiter(map(_name, tokens), np.int64, len(tokens))))
                        size += len(tokens)
                if size > FLUSH:
                    yield _token_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _token_batch(rows)
        common.given_back()

    return run


def _holds(wanted: np.ndarray, x: int) -> bool:
    at = wanted.searchsorted(x)
    return bool(at < len(wanted) and wanted[at] == x)


def _token_batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    leaves, owns, tokens = zip(*rows, strict=True)
    ends = pa.array(np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(owns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens)))], ["part", "own", "tokens"])


def _parted(group: pa.Table) -> pa.Table:
    """own, template: lines of parts of a part that agree."""
    own = group.column("own").to_numpy()
    tokens = group.column("tokens").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
    owns, templates = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    most, todo = int(tokens.shape[1] * VARIABLE), [(group.column("part")[0].as_py(), np.arange(len(own)))]
    while todo:
        part, rows = todo.pop()
        here = np.sort(tokens[rows], axis=0)
        distinct = (here[1:] != here[:-1]).sum(axis=0) + 1
        variable = np.flatnonzero(distinct > 1)
        if len(variable) <= most:
            owns.append(own[rows])
            templates.append(np.full(len(rows), part))
        elif len(rows) > 2:
            place = int(variable[distinct[variable].argmin()])
            values = tokens[rows, place]
            order = values.argsort(kind="stable")
            for piece in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
                if len(piece) > 1:
                    todo.append((_name(b"%d %d %d" % (part, place, values[piece[0]])), rows[piece]))
    return pa.table({"own": pa.array(np.concatenate(owns), pa.int64()), "template": pa.array(np.concatenate(templates), pa.int64())})


def _agreed(docs: DataFrame, owns: DataFrame) -> DataFrame:
    """own, template: lines that agree with others at all but VARIABLE of their places. Parts that one task can hold are
    parted there, larger ones on Spark, a place at a time."""
    several = owns.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select(F.col("leaf").alias("part"))
    several = common.settled(several, "leaves")
    if several.count() <= SMALL:
        wanted = np.sort(np.array([r["part"] for r in several.collect()], np.int64))
        lines = docs.select("text").mapInArrow(_tokens(wanted), TOKENS)
    else:  # too many to send along: all lines' tokens are joined to them
        lines = docs.select("text").mapInArrow(_tokens(None), TOKENS).join(several, "part", "left_semi")
    lines = common.settled(lines.groupBy("own").agg(F.first("part").alias("part"), F.first("tokens").alias("tokens")), "line-tokens")
    found = []
    while True:
        sizes = lines.groupBy("part").agg(F.count("*").alias("lines"), F.sum(F.size("tokens")).alias("size")).where("lines > 1")
        sizes = common.settled(sizes.select("part", (F.col("size") > PART).alias("large")), "parts")
        small = lines.join(sizes.where("not large"), "part", "left_semi").select("part", "own", "tokens")
        found.append(small.groupBy("part").applyInArrow(_parted, AGREED))
        if sizes.where("large").isEmpty():
            break
        large = common.settled(lines.join(F.broadcast(sizes.where("large")), "part", "left_semi"), "large-parts")
        places = large.select("part", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
        places = places.groupBy("part", "n", "place", "token").agg(F.lit(1).alias("one")).groupBy("part", "n", "place").agg(F.count("*").alias("distinct")).where("distinct > 1")
        ruled = places.groupBy("part", "n").agg(F.count("*").alias("variable"), F.min(F.struct("distinct", "place"))["place"].alias("place"))
        ruled = common.settled(ruled.select("part", "place", (F.col("variable") <= F.floor(F.col("n") * VARIABLE)).alias("agrees")), "ruled-parts")
        ruled_lines = large.join(F.broadcast(ruled), "part")
        found.append(ruled_lines.where("agrees").select("own", F.col("part").alias("template")))
        parted = F.xxhash64("part", "place", F.get("tokens", F.col("place")))
        lines = common.settled(ruled_lines.where("not agrees").select("own", parted.alias("part"), "tokens"), "line-tokens")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, lines: for each row that loses lines, the masked lines' names."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key("doc_id", "text").alias("doc"), "text")
    rows = common.settled(own.mapInArrow(_parsed(min_tokens), LINES), "lines")
    # Rows, not distinct keys, are counted, so that repeated rows count.
    owns = rows.groupBy("own").agg(F.min("leaf").alias("leaf"), F.count("*").alias("times"), F.min("doc_id").alias("least"))
    owns = common.settled(owns, "masked-lines")
    hot = common.hot_keys(owns.select("own", "times"), "own", "times", rows.count())
    agreed = common.settled(_agreed(docs, owns), "agreed-lines")
    # A template can't be in more documents than its lines have rows; those that may be in enough are counted.
    bounded = agreed.join(owns.select("own", "times"), "own").groupBy("template").agg(F.sum("times").alias("most")).where(F.col("most") >= min_docs)
    seen = common.join_hot(rows.select("doc_id", "doc", "own"), common.settled(agreed.join(bounded, "template", "left_semi"), "templates"), "own", hot)
    per_doc = seen.groupBy("template", "doc").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"), F.count_distinct("own").alias("lines"))
    frequent = per_doc.groupBy("template").agg(F.sum(F.ceil(F.col("times") / F.col("lines"))).alias("docs"), F.min("doc_id").alias("least")).where(F.col("docs") >= min_docs)
    frequent = common.settled(frequent.select("template", "least"), "frequent")
    alone = owns.where(F.col("times") >= min_docs).join(agreed, "own", "left_anti").select("own", "least")
    named = common.settled(agreed.join(frequent, "template").select("own", "least").unionByName(alone), "dropped-lines")
    lost = common.join_hot(rows.select("doc_id", "doc", "own"), named, "own", hot).where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return lost.groupBy("doc").agg(F.collect_set("own").alias("lost"))


@F.pandas_udf(EDITED)
def _edited(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
    """The text without its lost lines, and how many it lost; null where no text is given."""
    out = []
    for text, names in zip(texts, lost, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        names = set(names)
        lines = text.encode().split(b"\n")
        kept = [x for x in lines if own_of(masked(x)) not in names]
        out.append((b"\n".join(kept).decode(), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["text", "lost"])


def _split_by_fate(docs: DataFrame, min_docs: int, min_tokens: int) -> DataFrame:
    """row (all columns of docs), text (what is left of it), dropped (lines lost)."""
    lost = recurring(docs.select("doc_id", "text"), min_docs, min_tokens).select(F.col("doc").alias("key"), "lost")
    keyed = docs.select(common.row_key("doc_id", "text").alias("key"), F.struct(*common.quoted(docs.columns)).alias("row"))
    joined = keyed.join(lost, "key", "left").select("row", F.col("row").getField("text").alias("text"), "lost")
    # Only texts that lose lines go to Python and back.
    joined = joined.withColumn("edited", _edited(F.when(F.col("lost").isNotNull(), F.col("text")), F.coalesce("lost", F.array().cast("array<long>"))))
    return joined.select("row", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.col("edited.text")).alias("text"), F.coalesce("edited.lost", F.lit(0)).alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with texts that lost their recurring lines; a document that lost all it had goes. All columns stay."""
    marked = _split_by_fate(docs, min_docs, min_tokens)
    full = marked.where((F.col("dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return full.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_md5 for each row; a null text has no lines."""
    marked = _split_by_fate(docs.select("doc_id", "text"), min_docs, min_tokens)
    whole = F.col("row.text")
    n_lines = F.when(whole.isNull(), 0).otherwise(F.length(whole) - F.length(F.translate(whole, "\n", "")) + 1)
    return marked.select("row.doc_id", n_lines.cast("long").alias("n_lines"), F.col("dropped").cast("long").alias("n_dropped"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(common.table(spark, sf_dir, "documents"), min_tokens=1)
