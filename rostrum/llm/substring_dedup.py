"""Substring deduplication by recompression over words.

Words are named by hashes. In each round, first every maximal run of one name gets a name made of that name and the run's
length, then neighbours whose names fall on the left and right side of a fixed coin get a name made of both. Names depend
on content alone, so all documents name alike without an exchange, and equal substrings get equal symbols except near
their ends. A symbol carries the stretch of words that its making looked at; inside a window only symbols count whose
stretch lies in the window, and among them the longest, then least, is the window's high-level symbol. Spark brings
windows together by that symbol: symbols shared by no second place are dropped first, the rest are verified by the whole
window. A window without such a symbol (long runs of one word) stands for itself.

Defined cases: a null text has no words; repeated rows count as documents of their own, so their windows repeat; texts
under 35 words lose nothing; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, hashing, repeats

U = np.uint64
LENGTH, ROUNDS = 35, 2
#: Words of a long text that are looked at together; bits of a key that hold a place among them.
SEGMENT, PLACE = 1 << 16, 28
SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_NAMES = (np.random.default_rng(103).integers(0, 1 << 62, 4, dtype=np.uint64) << U(1)) | U(1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, _, _, firsts = hashing.words(data, offsets)
    return names, firsts


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    names, *_ = hashing.words(data, np.array([0, len(data)]))
    for at in range(0, len(names), SEGMENT):
        yield names[at : at + SEGMENT]


def recompressed(tokens: np.ndarray, firsts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: name, words it spans, and the stretch [low, high) of words that its making looked at.
    A stretch that would need a word before the first or after the last of a document reaches beyond it."""
    n = len(tokens)
    name, at = tokens, np.arange(n)
    low, high = at.copy(), at + 1
    firsts = firsts[:-1][np.diff(firsts) > 0]
    first = np.zeros(n, bool)
    first[firsts] = True
    ends = np.r_[firsts[1:], n]  # of the document that begins at firsts
    for k in range(rounds):
        start = np.flatnonzero(first | np.r_[True, name[1:] != name[:-1]])
        stop = np.r_[start[1:], len(name)] - 1
        size = (stop - start + 1).astype(np.uint64)
        # whether the run goes on depends on both neighbours
        name, at, first, low, high = np.where(size > 1, hashing.mixed(name[start] * _NAMES[0] + size), name[start]), at[start], first[start], *_reach(start, stop, first, low, high, firsts, ends, at, True, True)
        last = np.r_[first[1:], True]
        right = (hashing.mixed(name + _NAMES[1] * U(k + 1)) >> U(40) & U(1)).astype(bool)
        joined = np.zeros(len(name), bool)
        joined[1:] = ~right[:-1] & right[1:] & ~last[:-1]
        start = np.flatnonzero(~joined)
        stop = np.r_[start[1:], len(name)] - 1
        made = np.where(stop > start, hashing.mixed(name[start] * _NAMES[2] + name[stop] * _NAMES[3]), name[start])
        low, high = _reach(start, stop, first, low, high, firsts, ends, at, right[start], ~right[stop])
        name, at, first = made, at[start], first[start]
    return name, np.diff(np.r_[at, n]), low, high


def _reach(start, stop, first, low, high, firsts, ends, at, looks_left, looks_right) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the symbols made of [start, stop], which look at a neighbour's whole stretch or not."""
    here = np.searchsorted(firsts, at[start], "right") - 1
    last = np.r_[first[1:], True]
    left = np.where(first[start], firsts[here] - 1, low[np.maximum(start - 1, 0)])
    right = np.where(last[stop], ends[here] + 1, high[np.minimum(stop + 1, len(high) - 1)])
    return np.where(looks_left, left, low[start]), np.where(looks_right, right, high[stop])


def _anchors(length: int):
    def anchors(tokens: np.ndarray, firsts: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name, spans, low, high = recompressed(tokens, firsts)
        key = (U(15) - np.minimum(spans, 15).astype(np.uint64) << U(60)) | (hashing.mixed(name) >> U(32) << U(PLACE)) | np.arange(len(name), dtype=np.uint64)
        a, b = np.searchsorted(low, starts, "left"), np.searchsorted(high, starts + length, "right")
        found, size = np.full(len(starts), -1), b - a
        level, least = 1, key
        while True:
            here = np.flatnonzero((size >= level) & (size < 2 * level))
            if len(here):
                found[here] = (np.minimum(least[a[here]], least[b[here] - level]) & U((1 << PLACE) - 1)).astype(np.int64)
            if 2 * level > length or 2 * level > len(key):
                break
            least = np.minimum(least[: len(least) - level], least[level:])
            level *= 2
        alone = found < 0
        found[alone] = -1 - starts[alone]
        return np.where(alone, hashing.mixed(hashes ^ _NAMES[0]), name[np.maximum(found, 0)]), found

    return anchors


def scheme(length: int = LENGTH) -> repeats.Scheme:
    return repeats.Scheme(length, _tokens, _parts, _anchors(length), anywhere=True)


def without(text: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    spaced = SPACES.sub(b" ", text).strip(b" ")
    gaps = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
    n = len(gaps) + 1 if spaced else 0
    if not stretches:
        return n, 0, spaced
    begin, end = (lambda k: int(gaps[k - 1]) + 1 if k else 0), (lambda k: int(gaps[k - 1]) if k < n else len(spaced))
    kept = [spaced[begin(a) : end(b)] for a, b in repeats.left_over(stretches, n)]
    return n, sum(b - a for a, b in stretches), b" ".join(kept)


def _kept(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[int, int, bytes]]]]:
    for batch in batches:
        pairs = zip(batch.column("text"), batch.column("runs"), strict=True)
        yield batch.column("doc_id"), [without(repeats.bytes_of(text), repeats.covered(runs.as_py(), length)) for text, runs in pairs]
    common.given_back()


def dedup_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words outside every `length`-word window that starts anywhere else too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _kept(length, batches):
            arrays = [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeats.with_repeats(docs, scheme(length)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _kept(length, batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[2].decode() for r in rows], pa.string())], ["doc_id", "text"])

    return repeats.with_repeats(docs, scheme(length)).mapInArrow(run, "doc_id long, text string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_words(common.table(spark, sf_dir, "documents"))
