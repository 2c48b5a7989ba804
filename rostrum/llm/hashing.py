"""Hashes of bytes, words and windows over whole batches of text, as NumPy arrays of 64-bit numbers."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers for joining two halves of a window, by the logarithm of its length.
_JOIN = (np.random.default_rng(101).integers(0, 1 << 62, 32, dtype=np.uint64) << U(1)) | U(1)
_BYTE = np.random.default_rng(102).integers(0, 1 << 62, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
ODD = U(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
#: Bytes that are looked at together.
BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _powers = np.cumprod(np.r_[U(1), np.full(size - 1, _STEP, np.uint64)], dtype=np.uint64)
    return _powers


def _sums(part: np.ndarray, begins: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, starts and ends of the words of a block of bytes; a word ends where a text begins."""
    n = len(part)
    solid = (part != 32) & ((part < 9) | (part > 13))
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    starts = np.flatnonzero(solid & (edge[:n] | np.r_[True, ~solid[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[~solid[1:], True])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    if lower:
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
    begun = np.zeros(n, np.int32)
    begun[starts] = starts
    place = np.arange(n, dtype=np.int32) - np.maximum.accumulate(begun, out=begun)
    value = _BYTE[part]
    value *= _power_table(n)[place]
    value[~solid] = 0
    return np.add.reduceat(value, starts), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of the words of all documents, and each document's first word (n + 1). Works a
    block of bytes at a time; a word that a block leaves open is carried on to the next."""
    none = np.zeros(0, np.int32)
    out, firsts = [(np.zeros(0, np.uint64), none, none)], np.zeros(len(offsets), np.int64)
    done, carried = 0, None  # words so far; sum, length and start of an open one
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        a, b = np.searchsorted(offsets, [at, at + len(part)])
        begins = offsets[a:b] - at
        sums, starts, ends = _sums(part, begins, lower)
        lengths, first, last = ends - starts, (starts + at).astype(np.int32), (ends + at).astype(np.int32)
        if carried:
            total, length, begun = carried
            if len(starts) and starts[0] == 0 and not (len(begins) and begins[0] == 0):
                sums[:1] = total + sums[:1] * U(pow(int(_STEP), length, 1 << 64))
                lengths[0] += length
                first[0] = begun
            else:
                out.append((_named(total, np.array([length])), np.array([begun], np.int32), np.array([begun + length], np.int32)))
                done += 1
            carried = None
        firsts[a:b] = done + np.searchsorted(starts, begins)
        if len(ends) and ends[-1] == len(part) and at + BLOCK < len(data):
            carried = sums[-1:].copy(), int(lengths[-1]), int(first[-1])
            sums, lengths, first, last = sums[:-1], lengths[:-1], first[:-1], last[:-1]
        out.append((_named(sums, lengths), first, last))
        done += len(sums)
    firsts[np.searchsorted(offsets, len(data)) :] = done
    names, first, last = (np.concatenate([x[i] for x in out]) for i in range(3))
    return names, first, last, firsts


def _named(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mixed(sums + lengths.astype(np.uint64) * _JOIN[31])


def window_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of tokens[i : i + length] for each i that has room; joins halves, so that a pass costs log(length) steps."""
    if len(tokens) < length:
        return np.zeros(0, np.uint64)
    size, level, h = 1, 0, tokens
    while size * 2 <= length:
        h = h[:-size] * _JOIN[level] + h[size:]
        size, level = size * 2, level + 1
    if size < length:
        gap = length - size
        h = h[:-gap] * _JOIN[level] + mixed(h[gap:])
    return mixed(h)


def sliding_min(x: np.ndarray, length: int) -> np.ndarray:
    """min(x[i : i + length]) for each i that has room."""
    if len(x) < length:
        return x[:0]
    size = 1
    while size * 2 <= length:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < length:
        x = np.minimum(x[: len(x) - (length - size)], x[length - size :])
    return x


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All start + 0 .. start + count - 1, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(starts - starts_of(counts)[:-1], counts)
    return at + np.arange(total)
