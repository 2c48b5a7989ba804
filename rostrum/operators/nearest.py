"""The nearest rows of one part of a table in another: what two parts in a task have to say about each other.

Products in single precision sort out rows that can't be among the nearest, with room for their rounding; what is left is
measured in double precision. Rows are looked at in strips, so a task needs little more than the two parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Rows of a strip, columns that it meets at a time, and pairs that are measured at a time.
STRIP, ACROSS, MEASURED = 512, 8192, 1 << 16
#: Parts of a table that is smaller than their full size, and the least rows for which one more is made.
PARTS, LEAST = 8, 1024


def parts(rows: int, most: int) -> int:
    """How many parts of at most (about) so many rows; smaller tables make some too, so that all cores have work."""
    return max(-(-rows // most), min(PARTS, -(-rows // LEAST)), 1)


class Filter:
    """Pairs of rows whose cost may be at most a limit of the row of x. Costs are euclidean distances, or negative products."""

    def __init__(self, x: np.ndarray, y: np.ndarray, euclidean: bool):
        middle = y.mean(axis=0) if euclidean else 0.0
        a, b = x - middle, y - middle
        self.euclidean, self.scale = euclidean, float(np.sqrt(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max()))) or 1.0
        a, b = a / self.scale, b / self.scale
        self.half = (a * a).sum(axis=1) / 2 if euclidean else np.zeros(len(a))
        self.a = np.hstack([a, np.ones((len(a), 1))])
        self.b = np.hstack([b, -(b * b).sum(axis=1)[:, None] / 2 if euclidean else np.zeros((len(b), 1))]).T
        self.a32, self.b32 = self.a.astype(np.float32), self.b.astype(np.float32)
        self.slack, self.slack64 = (x.shape[1] + 8) * 2e-7, (x.shape[1] + 8) * 1e-15

    def below(self, rows: np.ndarray, across: slice, limit: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places in rows and across of pairs that may reach the limit; rows without one look for their `first` least."""
        with np.errstate(invalid="ignore"):
            need = self.half[rows] - (limit / self.scale) ** 2 / 2 if self.euclidean else -limit / self.scale**2
        score = self.a32[rows] @ self.b32[:, across]
        free = np.flatnonzero(~np.isfinite(need))
        if len(free) and 0 < first < score.shape[1]:
            at = score.shape[1] - first
            need[free] = np.partition(score[free], at, axis=1)[:, at] - self.slack
        i, j = np.nonzero(score >= (need - self.slack).astype(np.float32)[:, None])
        if len(i) > max(len(rows) * 64, score.size // 16):  # single precision does not tell them apart
            close = self.a[rows] @ self.b[:, across] >= (need - self.slack64 - (self.slack * (len(free) > 0)))[:, None]
            i, j = np.nonzero(close)
        return i, j


class Sieve:
    """Named parts of a table, ready for the products of any two that give -d*d / 2 of their rows, in single precision."""

    def __init__(self, parts: dict[int, np.ndarray]):
        full = [x for x in parts.values() if len(x)]
        middle = full[0].mean(axis=0) if full else 0.0
        self.scale = float(np.sqrt(max((((x - middle) ** 2).sum(axis=1).max() for x in full), default=0.0))) or 1.0
        self.parts, self.single = {b: (x - middle) / self.scale for b, x in parts.items()}, {}
        dims = full[0].shape[1] if full else 0
        self.slack, self.slack64 = (dims + 8) * 2e-7, (dims + 8) * 1e-15

    def _sides(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.parts[b]
        half, one = (x * x).sum(axis=1)[:, None] / 2, np.ones((len(x), 1))
        return np.hstack([x, -half, one]), np.hstack([x, one, -half]).T

    def products(self, i: int, rows: slice, j: int) -> np.ndarray:
        for b in (i, j):
            if b not in self.single:
                self.single[b] = [x.astype(np.float32) for x in self._sides(b)]
        return self.single[i][0][rows] @ self.single[j][1]

    def places(self, i: int, rows: slice, j: int, score: np.ndarray, limit: np.ndarray, slack: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in i and j, so many at a time, of pairs whose distance may be at most the limit of the pair."""
        need = -((np.maximum(limit, 0) / self.scale) ** 2) / 2
        need[limit < 0] = np.inf
        r, c = np.nonzero(score >= np.maximum(need - self.slack, -1e30).astype(np.float32))
        if len(r) > max(len(score) * 64, score.size // 16):  # single precision does not tell them apart
            close = self._sides(i)[0][rows] @ self._sides(j)[1]
            r, c = np.nonzero((close >= need - self.slack64) & (score > -np.inf))
        for s in range(0, len(r), MEASURED):
            yield r[s : s + MEASURED] + rows.start, c[s : s + MEASURED]

    def within(self, i: int, rows: slice, j: int, one: np.ndarray, two: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`places` of pairs within the limit of either row; rows of i without one look for their `first` nearest."""
        score = self.products(i, rows, j)
        one, free = one.copy(), np.flatnonzero(~np.isfinite(one))
        if len(free) and first < score.shape[1]:
            at = score.shape[1] - first
            least = np.partition(score[free], at, axis=1)[:, at].astype(np.float64) - self.slack
            one[free] = self.scale * np.sqrt(np.maximum(-2 * least, 0))
        yield from self.places(i, rows, j, score, np.maximum(one[:, None], two))


def euclidean(a: np.ndarray, b: np.ndarray, places: int) -> np.ndarray:
    return np.round(np.sqrt(((a - b) ** 2).sum(axis=1)), places)


def nearest(keys: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, cost: Callable, euclidean: bool, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """key, other, cost of the k rows of y that cost least for each row of x, of equals the lesser other; with `own` a row
    of the same key counts. cost(a, b) measures paired rows."""
    if not len(x) or not len(y):
        return
    order = np.argsort(others, kind="stable")
    others, y = others[order], y[order]
    sieve = Filter(x, y, euclidean)
    for top in range(0, len(x), STRIP):
        rows = np.arange(top, min(top + STRIP, len(x)))
        best, at = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1)
        for left in range(0, len(y), ACROSS):
            across = slice(left, min(left + ACROSS, len(y)))
            i, j = sieve.below(rows, across, best[:, -1], k + (not own))
            for s in range(0, len(i), MEASURED):
                r, c = i[s : s + MEASURED], j[s : s + MEASURED] + left
                d = cost(x[rows[r]], y[c])
                new = (d < best[r, -1]) & (own | (keys[rows[r]] != others[c]))  # later ones have greater keys, so equals come too late
                if new.any():
                    merge(best, at, r[new], c[new], d[new])
        real = at >= 0
        yield np.repeat(keys[rows], real.sum(axis=1)), others[at[real]], best[real]


def merge(best: np.ndarray, at: np.ndarray, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
    k = best.shape[1]
    some = np.unique(r)
    r = np.r_[np.repeat(some, k), r]
    d, c = np.r_[best[some].ravel(), d], np.r_[at[some].ravel(), c]
    order = np.lexsort((c, d, r))
    r, d, c = r[order], d[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    kept = place < k
    best[r[kept], place[kept]], at[r[kept], place[kept]] = d[kept], c[kept]
