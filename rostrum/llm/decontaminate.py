"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap checks.

The index holds the test items; every passage of every training document is a query, taken as the set of its tokens.
An item's terms are essential if the rest of its terms alone can't reach its threshold (a share of the item's score
against itself); a passage without an essential term of an item can't reach that item, so postings of essential terms
alone drive the search. Items stand in blocks of 64. For each passage and block, the essential terms' block maxima plus
the most that the block's items can gain beyond them bound the score; blocks, then items, whose bound stays under their
least threshold are skipped, the rest are scored in full. An item that scores enough is confirmed if the passage holds
most of its question's five-token shingles (the first two thirds of its tokens) and most of its answer's tokens (the
rest). Nothing is cut off: all passages, and all items above their threshold, are looked at.

Passages are as long as an item's own length asks for: items are indexed by length class, and each class has a stride, the
least of STRIDE, twice, four times it and so on that holds the item. Other items' lengths don't matter to it. Texts are
looked at in slabs of SLAB tokens that overlap by the longest stride, so every passage lies in one.

Document frequencies and the mean length are those of all items. Items are indexed in groups of about GROUP_BYTES of text,
one pass over the documents for each, so that what a task holds is bounded however large the benchmark is; the groups don't
change the result.

Defined cases: null or blank items match nothing, nor do items of one token, which have no answer to verify; a null text has no passages; repeated rows each get their result; empty
tables give an empty result or no hits; columns other than doc_id and text (item_id and text) are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its question and answer that it must hold.
SCORE, OVERLAP, SHINGLE, BLOCK = 0.5, 0.75, 5, 64
GROUP_BYTES = 4 << 20
#: Tokens between passage starts; a passage is twice as long, so any run of STRIDE tokens lies in one. Longer items get
#: longer strides.
STRIDE = 64
#: Tokens that are searched at once, of one text or several.
SLAB = 1 << 18
TOKEN = re.compile(r"\w+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def stride_of(size: int) -> int:
    """Tokens between starts of the passages that are held against an item of so many tokens."""
    return STRIDE << max(0, (-(-size // STRIDE) - 1).bit_length())


def _shingles(tokens: list, n: int = SHINGLE) -> set:
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()


@dataclass
class Statistics:
    """Of all items: their number, mean length in tokens, and the number of items that hold a term."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, split: list[list[str]]) -> Statistics:
        return cls(len(split), sum(map(len, split)) / max(1, len(split)), Counter(w for t in split for w in set(t)))


class Index:
    def __init__(self, items: list[tuple[int, list[str]]], whole: Statistics, stride: int):
        """The tokens of items of one length class; whole: the statistics of all items."""
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        self.stride = stride
        n, mean = len(items), whole.mean
        df = sorted({w for t in self.tokens for w in t})
        self.term = {w: k for k, w in enumerate(df)}
        idf = {w: math.log(1 + (whole.n - whole.df[w] + 0.5) / (whole.df[w] + 0.5)) for w in df}
        self.gain: list[dict[str, float]] = []
        for t in self.tokens:
            norm = K1 * (1 - B + B * len(t) / mean)
            self.gain.append({w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(t).items()})
        own = np.array([sum(g.values()) for g in self.gain]) if n else np.zeros(0)
        self.least = SCORE * own
        self.rest = np.zeros(n)
        postings: list[tuple[int, int, float]] = []
        for k, g in enumerate(self.gain):
            for w, x in sorted(g.items(), key=lambda p: (p[1], p[0])):
                if self.rest[k] + x < self.least[k]:
                    self.rest[k] += x
                else:
                    postings.append((self.term[w], k, x))
        postings.sort()
        self.p_item = np.array([k for _, k, _ in postings], np.int64)
        self.p_gain = np.array([x for *_, x in postings], np.float64)
        self.essential = {df[w]: w for w, *_ in postings}
        self.first = np.searchsorted([w for w, *_ in postings], np.arange(len(self.term) + 1)) if postings else np.zeros(len(self.term) + 1, np.int64)
        # Block maxima: a term's best gain in each block of items.
        blocks: dict[tuple[int, int], float] = {}
        for w, k, x in postings:
            blocks[w, k // BLOCK] = max(blocks.get((w, k // BLOCK), 0.0), x)
        keys = sorted(blocks)
        self.b_block = np.array([b for _, b in keys], np.int64)
        self.b_gain = np.array([blocks[x] for x in keys])
        self.b_first = np.searchsorted([w for w, _ in keys], np.arange(len(self.term) + 1)) if keys else np.zeros(len(self.term) + 1, np.int64)
        # What an item's essential terms have to bring at least; a block's is the least of its items'.
        self.need = self.least - self.rest
        self.b_need = np.minimum.reduceat(self.need, np.arange(0, n, BLOCK)) if n else np.zeros(0)

    def search(self, passage: np.ndarray, term: np.ndarray, words_of: Callable[[int], set[str]]) -> list[tuple[int, int]]:
        """(passage, item) pairs whose score reaches the item's threshold. passage, term: where essential terms stand;
        words_of gives a passage's tokens."""
        if not len(passage):
            return []
        passage, term = np.divmod(np.unique(passage * len(self.term) + term), len(self.term))
        alive = self._bounded(passage, term, self.b_first, self.b_block, self.b_gain, self.b_need)
        if not len(alive):
            return []
        n_blocks = len(self.b_need)
        keep = np.isin(passage, alive // n_blocks)
        pairs = self._bounded(passage[keep], term[keep], self.first, self.p_item, self.p_gain, self.need)
        pairs = pairs[np.isin(pairs // len(self.ids) * n_blocks + pairs % len(self.ids) // BLOCK, alive)]
        out, last, here = [], -1, set()
        for p, k in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(self.ids)))), strict=True):
            if p != last:
                last, here = p, words_of(p)
            if sum(x for w, x in self.gain[k].items() if w in here) >= self.least[k] - 1e-9:
                out.append((p, k))
        return out

    @staticmethod
    def _bounded(passage, term, first, target, gain, need) -> np.ndarray:
        """passage * len(need) + target for those whose summed gains reach what they need."""
        count = first[term + 1] - first[term]
        at = np.repeat(first[term] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        key = np.repeat(passage, count) * len(need) + target[at]
        found, where = np.unique(key, return_inverse=True)
        sums = np.bincount(where, weights=gain[at], minlength=len(found))
        return found[sums >= need[found % len(need)] - 1e-9]

    def confirmed(self, item: int, passage: list[str]) -> bool:
        """Whether the passage holds the item's question and answer."""
        own = self.tokens[item]
        cut = max(1, len(own) * 2 // 3)
        question, answer = _shingles(own[:cut]), Counter(own[cut:])
        held = _shingles(passage, min(SHINGLE, cut))
        if len(question & held) < OVERLAP * len(question):
            return False
        both = answer & Counter(passage)
        return both.total() >= OVERLAP * answer.total()


def by_length(items: list[tuple[int, str]], whole: Statistics | None = None) -> list[Index]:
    """An index for each length class, shortest first. whole: the statistics of all items, of which items may be a part."""
    classes: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
    for i, t in ((i, tokens_of(t)) for i, t in items):
        if len(t) > 1:
            classes[stride_of(len(t))].append((i, t))
    whole = whole or Statistics.of([t for c in classes.values() for _, t in c])
    return [Index(classes[stride], whole, stride) for stride in sorted(classes)]


def _slabs(text: str, overlap: int) -> Iterator[list[str]]:
    """A text's tokens, a slab at a time with the next `overlap` tokens. Passages that begin in the overlap come whole in
    the next slab; there they may be cut short, which can't add a hit."""
    step = max(SLAB, overlap)
    if len(text) <= step:
        yield tokens_of(text)
        return
    words, held = (m.group() for m in TOKEN.finditer(text.lower())), []
    while True:
        held += islice(words, step + overlap - len(held))
        yield held
        if len(held) <= step:
            return
        held = held[step:]


def _hits(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: set[tuple[int, int]] = set()
            keys, slabs, size = [], [], 0
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                for slab in _slabs(text.as_py(), indexes[-1].stride if indexes else 0):
                    keys.append(key)
                    slabs.append(slab)
                    size += len(slab)
                    if size >= SLAB:
                        hits |= {(keys[k], index.ids[item]) for index in indexes for k, item in _found(index, slabs)}
                        keys, slabs, size = [], [], 0
            hits |= {(keys[k], index.ids[item]) for index in indexes for k, item in _found(index, slabs)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["key", "item_id"])
        common.given_back()

    return run


def _found(index: Index, tokens: list[list[str]]) -> set[tuple[int, int]]:
    """(text, item) for each item that the tokens of a text hold. Passages of all texts are numbered through; passage p of
    a text covers its tokens p * stride to (p + 2) * stride."""
    essential, stride = index.essential, index.stride
    first = np.concatenate(([0], np.cumsum([len(t) // stride + 1 for t in tokens])))
    passages, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, words in enumerate(tokens):
        at = [i for i, w in enumerate(words) if w in essential]
        if at:
            own, term = np.array(at) // stride, np.array([essential[words[i]] for i in at])
            passages += [own + first[k], np.maximum(own - 1, 0) + first[k]]
            terms += [term, term]

    def passage(p: int) -> tuple[int, list[str]]:
        k = int(np.searchsorted(first, p, "right")) - 1
        return k, tokens[k][(p - first[k]) * stride : (p - first[k] + 2) * stride]

    pairs = index.search(np.concatenate(passages), np.concatenate(terms), lambda p: set(passage(p)[1]))
    return {(k, item) for p, item in pairs for k, words in [passage(p)] if index.confirmed(item, words)}


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [tokens_of(t.as_py()) for t in batch.column("text")]
        kept = [len(t) > 1 for t in split]
        distinct = pa.array([sorted(set(t)) for t, k in zip(split, kept, strict=True) if k], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([len(t) for t in split if len(t) > 1], pa.int64()), pa.array([i for i, k in zip(batch.column("item_id").to_pylist(), kept, strict=True) if k], pa.int64()), distinct], ["size", "item_id", "terms"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (row_key of doc_id and text), item_id for each item that a document holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    own = docs.select(common.row_key("doc_id", "text").alias("key"), "text").where("text is not null")
    group, whole, found = F.pmod(F.xxhash64("item_id"), F.lit(groups)), None, None
    if groups > 1:
        terms = common.settled(items.mapInArrow(_item_tokens, "size long, item_id long, terms array<string>"), "item-terms")
        each = terms.select(group.alias("group"), F.explode("terms").alias("term"))
        df = common.settled(each.groupBy("term").agg(F.count("*").alias("df")), "item-df")
        n, mean = terms.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    for g in range(groups):
        part = items.where(group == g) if groups > 1 else items
        if groups > 1:
            held = df.join(each.where(F.col("group") == g).select("term").distinct(), "term").collect()
            whole = Statistics(n, mean, {r["term"]: r["df"] for r in held})
        indexes = by_length(sorted((r["item_id"], r["text"]) for r in part.collect()), whole)
        hits = own.mapInArrow(_hits(indexes), "key long, item_id long")
        found = hits if found is None else found.union(hits)
    return found.distinct()


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, contaminated, items (ascending, joined by commas) for each row."""
    per_doc = leaks(docs, benchmark).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("found"))
    rows = docs.select("doc_id", common.row_key("doc_id", "text").alias("key"))
    joined = rows.join(per_doc, "key", "left")
    n = F.coalesce(F.size("found"), F.lit(0)).cast("long")
    return joined.select("doc_id", F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_items"), F.col("found").isNotNull().alias("contaminated"), F.coalesce(F.array_join(F.transform("found", lambda x: x.cast("string")), ","), F.lit("")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a test item; all columns stay."""
    bad = common.settled(leaks(docs, benchmark).select("key").distinct(), "leaks")
    keyed = docs.select(common.row_key("doc_id", "text").alias("key"), F.struct(*common.quoted(docs.columns)).alias("row"))
    return keyed.join(bad, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leak_report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
