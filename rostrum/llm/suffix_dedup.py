"""Suffix-array deduplication by a depth-limited radix sort over bytes.

Suffixes are ordered only as deep as the threshold (50 bytes), most significant digit first. The first digit of a window
is its anchor, the 16 bytes with the least hash among the window's 16-byte strings; windows under one anchor are
neighbouring suffixes. The first pass deals suffixes into buckets by that digit and drops groups whose digit occurs in one
document alone. The second pass orders what is left by the digit and the rest of the window; equal groups are exactly the
repeated windows. 40 bits of the digit's hash and 40 of the window's are compared within a bucket, about 1e-24 odds of a
false match for a pair.

Defined cases: a null text is empty; a null doc_id counts as larger than any other, and rows with equal doc_id don't
remove from each other; repeated rows each get a row; texts under 50 bytes lose nothing; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, hashing, repeats

U = np.uint64
LENGTH, DIGIT = 50, 16
#: Bits of a key that hold a place; the rest orders digits. Places count within a segment, which is far shorter.
PLACE = 28


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashing.byte_tokens(data), offsets


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(data), hashing.BLOCK):
        yield hashing.byte_tokens(data[at : at + hashing.BLOCK])


def _anchors(length: int, digit: int):
    def anchors(tokens: np.ndarray, firsts: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        digits = hashing.window_hashes(tokens, digit)
        key = (digits >> U(PLACE) << U(PLACE)) | np.arange(len(digits), dtype=np.uint64)
        place = (hashing.sliding_min(key, length - digit + 1)[starts] & U((1 << PLACE) - 1)).astype(np.int64)
        return digits[place], place

    return anchors


def scheme(length: int = LENGTH) -> repeats.Scheme:
    return repeats.Scheme(length, _tokens, _parts, _anchors(length, min(DIGIT, length)), anywhere=False)


def remaining(text: bytes, stretches: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in repeats.left_over(stretches, len(text)))


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = repeats.bytes_of(text)
                gone = repeats.covered(runs.as_py(), length)
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(remaining(data, gone) if gone else data).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        common.given_back()

    return run


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left of each text once every byte is removed that lies
    in a `length`-byte string which also starts in a document with a smaller doc_id."""
    found = repeats.with_repeats(docs, scheme(length))
    return found.mapInArrow(_digests(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the remaining text; bytes that no longer form a character are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                data = repeats.bytes_of(text)
                texts.append(remaining(data, repeats.covered(runs.as_py(), length)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return repeats.with_repeats(docs, scheme(length)).mapInArrow(run, "doc_id long, text string")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(common.table(spark, sf_dir, "documents"))
