"""Repeated windows of a corpus: the Spark side that substring and suffix deduplication share.

Every window of a fixed length is filed under one of its interior symbols, its anchor, which depends on the window's
content alone; neighbouring windows mostly share an anchor, so a text of n tokens has far fewer anchors than windows.
Neighbouring windows under one anchor form a unit. Long texts are looked at in segments that overlap by a window, so a
task holds little more than the text itself.

1. Anchors. Tasks send short digests of anchors and units, a row for each bucket, and learn the fate of each unit
   (`_send_names`, `_judge_names`, `_gather_fates`): its anchor stands nowhere else; an equal unit elsewhere decides it
   (gone); or units of other content share its anchor, so that its windows have to be looked at (open). Of equal units in a
   batch one is sent, and of equal units in the corpus one stays open, so a frequent passage has no more entries than there
   are batches, and one in the next step.
2. Windows. Open units send their windows by the anchor's name (`_send_windows`); tasks sort them by name and content;
   equal groups are the repeated windows (`_judge_windows`). Anchors with very many units of different content are hot: a
   batch that finds one sends a single entry for it, and its windows are dealt by their own content, of equal ones in a
   batch one, so that no task gets all units of one anchor.
3. What each document loses is gathered by its row key and joined to the text, which was dealt out once for both joins.

Tasks hold a shuffle partition at a time; the number of partitions follows the bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing

U = np.uint64
LOW32, LOW40 = U((1 << 32) - 1), U((1 << 40) - 1)
NO_DOC = np.iinfo(np.int64).max
#: Units of different content under one anchor, in a batch and in a task, from which on the anchor is hot.
HOT_BATCH, HOT_TASK = 256, 16384
#: Windows that a task collects before it sends them.
FLUSH = 1 << 20


@dataclass(frozen=True)
class Scheme:
    """length: tokens of a window. tokens(bytes, offsets) gives token hashes and each document's first token;
    parts(bytes) gives the token hashes of one long text, part by part. anchors(tokens, firsts, windows) gives each
    window's anchor: its name and its place (equal for windows that share it). anywhere: whether a window counts as
    repeated if it starts anywhere else, or only if in a smaller doc_id."""

    length: int
    tokens: Callable
    parts: Callable
    anchors: Callable
    anywhere: bool


@dataclass
class Runs:
    """Runs of neighbouring windows of a document under one anchor: name, document, first window, number of windows; and
    where each run's windows stand among the hashes."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    at: np.ndarray
    hashes: np.ndarray

    def units(self) -> np.ndarray:
        """Digest of a run's content: its first and last window overlap or touch the anchor, and so hold all of it."""
        first, last = self.hashes[self.at], self.hashes[self.at + self.count - 1]
        return hashing.mixed(self.name + hashing.mixed(first + hashing.mixed(last + self.count.astype(np.uint64))))


def runs_of(scheme: Scheme, tokens: np.ndarray, firsts: np.ndarray) -> Runs:
    room = np.maximum(np.diff(firsts) - scheme.length + 1, 0)
    starts = hashing.ranges(firsts[:-1], room)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Runs(none.astype(np.uint64), none, none, none, none, none.astype(np.uint64))
    hashes = hashing.window_hashes(tokens, scheme.length)[starts]
    name, place = scheme.anchors(tokens, firsts, starts, hashes)
    doc = np.repeat(np.arange(len(room)), room)
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    return Runs(name[at], doc[at], starts[at] - firsts[doc[at]], np.diff(np.r_[at, len(starts)]), at, hashes)


def all_runs(scheme: Scheme, data: np.ndarray, offsets: np.ndarray) -> Iterator[Runs]:
    """The runs of a batch of texts, some texts or a segment of a long one at a time."""
    for a, b in common.chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        if b - a > 1 or len(part) <= hashing.BLOCK:
            found = runs_of(scheme, *scheme.tokens(part, offsets[a : b + 1] - offsets[a]))
            found.doc = found.doc + a
            yield found
            continue
        held, at = np.zeros(0, np.uint64), 0
        for tokens in scheme.parts(part):
            tokens = np.r_[held, tokens]
            found = runs_of(scheme, tokens, np.array([0, len(tokens)]))
            found.doc, found.start = found.doc + a, found.start + at
            yield found
            held = tokens[max(0, len(tokens) - scheme.length + 1) :]
            at += len(tokens) - len(held)


def _low(x: np.ndarray, size: int = 5) -> np.ndarray:
    """The low bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def _from_low(data: bytes | np.ndarray, size: int = 5) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :size] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _groups(x: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours start."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[starts, n])


def _slices(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n][: len(starts)], strict=True))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("key").to_numpy(zero_copy_only=False), batch.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False)


NAMES = "route int, kind int, keys binary, docs binary, counts binary, names binary, units binary, flags binary"
#: What may be known of a unit, as bits: it is repeated as a whole; its windows have to be looked at; by their content.
GONE, OPEN, HOT = 1, 2, 4
#: Flags of an entry: the unit stands in further documents of its batch; its anchor is hot.
AGAIN, HEATED = 1, 2
#: Bytes of a fate: 56 bits of the unit's digest and what is known of it.
FATE, LOW56 = 8, U((1 << 56) - 1)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    """route and kind as 32-bit numbers, all else as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *map(common.binary_column, columns[2:])], names)


def _told(name: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """What a document knows a unit by."""
    return hashing.mixed((unit & LOW40) + hashing.mixed((name & LOW32) + U(1))) & LOW56


def _fates(name: np.ndarray, unit: np.ndarray, fate: np.ndarray) -> np.ndarray:
    return np.concatenate([_low(_told(name, unit), 7), fate.astype(np.uint8)[:, None]], axis=1)


def _send_names(scheme: Scheme, buckets: int):
    columns = ["route", "kind", "keys", "docs", "counts", "names", "units", "flags"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = common.text_buffers(batch.column("text"))
            keys, docs = _ids(batch)
            names, units, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for found in all_runs(scheme, data, offsets):
                names.append(found.name)
                units.append(found.units())
                rows.append(found.doc.astype(np.int32))
            name, unit, row = map(np.concatenate, (names, units, rows))
            del names, units, rows
            if not len(name):
                continue
            order = np.lexsort((docs[row], unit, name))
            name, unit, row = name[order], unit[order], row[order]
            doc = docs[row]
            new = np.r_[True, (unit[1:] != unit[:-1]) | (name[1:] != name[:-1])]
            at, n_at = np.flatnonzero(new), _groups(name)
            count, n_size = _sizes(at, len(unit)), _sizes(n_at, len(name))
            if scheme.anywhere:
                gone, again = np.repeat(count > 1, count), count > 1
                travels = new
            else:
                gone, again = doc > np.repeat(doc[at], count), doc[at + count - 1] > doc[at]
                travels = ~gone & (new | np.r_[True, row[1:] != row[:-1]])
            hot = np.add.reduceat(new, n_at) >= HOT_BATCH
            if not scheme.anywhere:
                hot &= np.minimum.reduceat(doc, n_at) != np.maximum.reduceat(doc, n_at)
            hot = np.repeat(hot, n_size)
            flags = np.repeat(again, count) * AGAIN | hot * HEATED
            # What this batch settles needs no answer.
            fate = gone * GONE | (hot & travels) * (OPEN | HOT)
            settled = np.flatnonzero(fate)
            settled = settled[np.argsort(row[settled], kind="stable")]
            r, sure = row[settled], _fates(name[settled], unit[settled], fate[settled])
            told = _groups(r)
            doc_keys, none = keys[r[told]], [b""] * len(told)
            yield _batch(columns, doc_keys % buckets, np.ones(len(told), int), [common.packed(k) for k in doc_keys], none, none, none, [sure[i:j].tobytes() for i, j in _slices(told, len(r))], none)
            # Of a hot anchor one entry travels, the first unit's.
            travels = travels & (~hot | np.isin(np.arange(len(name)), n_at))
            name, unit, row, flags = name[travels], unit[travels], row[travels], flags[travels]
            bucket = ((name >> U(40)) % U(buckets)).astype(np.int64)
            order = np.lexsort((row, bucket))
            n4, u5, r, bucket, flags = _low(name[order], 4), _low(unit[order]), row[order], bucket[order], flags[order].astype(np.uint8)
            parts = _slices(_groups(bucket), len(bucket))
            each = [(i, j, _groups(r[i:j])) for i, j in parts]
            yield _batch(
                columns, bucket[[i for i, _ in parts]], np.zeros(len(parts), int), [common.packed(keys[r[i:j][d]]) for i, j, d in each], [common.packed(docs[r[i:j][d]]) for i, j, d in each],
                [common.packed(_sizes(d, j - i).astype(np.int32)) for i, j, d in each], [n4[i:j].tobytes() for i, j in parts], [u5[i:j].tobytes() for i, j in parts], [flags[i:j].tobytes() for i, j in parts],
            )
        common.given_back()

    return run


FATES = "route int, keys binary, counts binary, fates binary"


def _by_group(key: np.ndarray, fate: np.ndarray, groups: int) -> pa.RecordBatch:
    """A row for each group of keys: distinct keys, their numbers of fates, the fates."""
    group = key % groups
    order = np.lexsort((key, group))
    key, fate, group = key[order], fate[order], group[order]
    parts = _slices(_groups(group), len(group))
    firsts = [_groups(key[i:j]) for i, j in parts]
    counts = [common.packed(_sizes(f, j - i).astype(np.int32)) for (i, j), f in zip(parts, firsts, strict=True)]
    arrays = [pa.array(group[[i for i, _ in parts]], pa.int32()), common.binary_column([common.packed(key[i:j][f]) for (i, j), f in zip(parts, firsts, strict=True)]), common.binary_column(counts), common.binary_column([fate[i:j].tobytes() for i, j in parts])]
    return pa.RecordBatch.from_arrays(arrays, ["route", "keys", "counts", "fates"])


def _gather_fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, fates = [np.zeros(0, np.int64)], [np.zeros((0, FATE), np.uint8)]
    for batch in batches:
        for row in batch.to_pylist():
            keys.append(np.repeat(np.frombuffer(row["keys"], np.int64), np.frombuffer(row["counts"], np.int32)))
            fates.append(np.frombuffer(row["fates"], np.uint8).reshape(-1, FATE))
    key, fate = np.concatenate(keys), np.concatenate(fates)
    del keys, fates
    order = np.argsort(key, kind="stable")
    key, fate = key[order], fate[order]
    docs = _slices(_groups(key), len(key))
    for i in range(0, len(docs), 20_000):
        part = docs[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[[a for a, _ in part]]), common.binary_column([fate[a:b].tobytes() for a, b in part])], ["key", "fates"])
    common.given_back()


def _judge_names(scheme: Scheme, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            ready = batch.filter(pa.array(kind == 1))
            if ready.num_rows:
                sent = ready.column("units").to_pylist()
                keys = np.repeat(np.frombuffer(b"".join(ready.column("keys").to_pylist()), np.int64), [len(x) // FATE for x in sent])
                yield _by_group(keys, np.frombuffer(b"".join(sent), np.uint8).reshape(-1, FATE), groups)
            for row in batch.filter(pa.array(kind == 0)).to_pylist():
                counts = np.frombuffer(row["counts"], np.int32)
                key, doc = (np.repeat(np.frombuffer(row[c], np.int64), counts) for c in ("keys", "docs"))
                parts.append((_from_low(row["names"], 4) | (U(row["route"]) << U(32)), _from_low(row["units"]), key, doc, np.frombuffer(row["flags"], np.uint8)))
        if not parts:
            return
        name, unit, key, doc, flags = (np.concatenate([p[i] for p in parts]) for i in range(5))
        del parts
        order = np.lexsort((doc, unit, name))
        name, unit, key, doc, flags = name[order], unit[order], key[order], doc[order], flags[order]
        n_at = _groups(name)
        n_size = _sizes(n_at, len(name))
        new = np.r_[True, (name[1:] != name[:-1]) | (unit[1:] != unit[:-1])]
        u_at = np.flatnonzero(new)
        u_size = _sizes(u_at, len(unit))
        distinct, known = np.add.reduceat(new, n_at), np.bitwise_or.reduceat(flags, n_at)
        hot = (distinct >= HOT_TASK) | (known & HEATED > 0)
        several = (distinct > 1) | hot  # units of other content under the anchor
        if scheme.anywhere:
            gone = np.repeat((u_size > 1) | (np.bitwise_or.reduceat(flags, u_at) & AGAIN > 0), u_size)
            open_ = new & np.repeat(several, n_size)
        else:
            several &= (np.minimum.reduceat(doc, n_at) != np.maximum.reduceat(doc, n_at)) | (known > 0)
            gone = doc > np.repeat(doc[u_at], u_size)
            open_ = ~gone & np.repeat(several, n_size)
        told = np.flatnonzero(gone | open_)
        if len(told):
            fate = gone * GONE | open_ * (OPEN | np.repeat(hot, n_size) * HOT)
            yield _by_group(key[told], _fates(name[told], unit[told], fate[told]), groups)
        common.given_back()

    return run


WINDOWS = "route int, kind int, keys binary, docs binary, counts binary, names binary, starts binary, sizes binary, weights binary, data binary"
WINDOW_COLUMNS = ["route", "kind", "keys", "docs", "counts", "names", "starts", "sizes", "weights", "data"]


def _pairs_by_key(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A row for each key: its runs as pairs of 32-bit start and count."""
    order = np.argsort(key, kind="stable")
    key, pairs = key[order], np.stack([start[order], count[order]], axis=1).astype(np.int32)
    at = _groups(key)
    return key[at], [common.packed(pairs[i:j]) for i, j in _slices(at, len(key))]


def _lost(key: np.ndarray, start: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs that are known to be repeated, neighbours joined, a row for each document."""
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], (start + count)[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != stop[:-1])])
    key, pairs = _pairs_by_key(key[new], start[new], stop[np.r_[new[1:], len(stop)] - 1] - start[new])
    none = [b""] * len(key)
    return _batch(WINDOW_COLUMNS, key % buckets, np.ones(len(key), int), [common.packed(k) for k in key], *[none] * 6, pairs)


@dataclass
class Open:
    """Runs whose windows have to be looked at: bucket, anchor, row, first window, number of windows, weight; and the
    windows' hashes, one run after the other."""

    bucket: np.ndarray
    name: np.ndarray
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    weight: np.ndarray
    hashes: np.ndarray

    def sent(self, keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket."""
        order = np.lexsort((self.start, self.row, self.bucket))
        bucket, row, count, start, weight, n5 = self.bucket[order], self.row[order], self.count[order], self.start[order].astype(np.int32), self.weight[order].astype(np.uint8), _low(self.name[order])
        five = _low(self.hashes[hashing.ranges(hashing.starts_of(self.count)[:-1][order], count)])
        ends = hashing.starts_of(count)
        parts = _slices(_groups(bucket), len(bucket))
        each = [(i, j, _groups(row[i:j])) for i, j in parts]
        return _batch(
            WINDOW_COLUMNS, bucket[[i for i, _ in parts]], np.zeros(len(parts), int), [common.packed(keys[row[i:j][d]]) for i, j, d in each], [common.packed(docs[row[i:j][d]]) for i, j, d in each],
            [common.packed(_sizes(d, j - i).astype(np.int32)) for i, j, d in each], [n5[i:j].tobytes() for i, j in parts], [common.packed(start[i:j]) for i, j in parts], [common.packed(count[i:j].astype(np.int32)) for i, j in parts],
            [weight[i:j].tobytes() for i, j in parts], [five[ends[i] : ends[j]].tobytes() for i, j in parts],
        )


def _content(name: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return hashing.mixed((name & LOW40) + hashing.mixed(hashes & LOW40))


def _by_content(scheme: Scheme, found: Open, docs: np.ndarray, buckets: int) -> tuple[Open, np.ndarray, np.ndarray]:
    """Runs of hot anchors as single windows dealt by content, of equal ones in a batch one; and rows and places of
    windows that the batch knows to be repeated."""
    of = np.repeat(np.arange(len(found.name)), found.count)
    name, row, weight = found.name[of], found.row[of], found.weight[of]
    start = found.start[of] + hashing.ranges(np.zeros(len(found.count), np.int64), found.count)
    content, doc = _content(name, found.hashes), docs[row]
    order = np.lexsort((doc, content))
    at = _groups(content[order])
    size = _sizes(at, len(order))
    first = np.zeros(len(order), bool)
    first[at] = True
    if scheme.anywhere:
        total = np.add.reduceat(weight[order], at)
        gone, sent = np.repeat(total > 1, size), first
        weight = np.minimum(np.repeat(total, size), 2)
    else:
        gone = doc[order] > np.repeat(doc[order][at], size)
        sent, weight = ~gone, weight[order]
    lost, kept = order[gone], order[sent]
    bucket = (hashing.mixed(content[kept]) % U(buckets)).astype(np.int64)
    return Open(bucket, name[kept], row[kept], start[kept], np.ones(len(kept), np.int64), weight[sent], found.hashes[kept]), row[lost], start[lost]


def _send_windows(scheme: Scheme, buckets: int):
    def flushed(parts: list[Open], keys: np.ndarray, docs: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        found = Open(*(np.concatenate([getattr(p, f) for p in parts]) for f in Open.__dataclass_fields__))
        parts.clear()
        if hot:
            found, row, start = _by_content(scheme, found, docs, buckets)
            if len(row):
                yield _lost(keys[row], start, np.ones(len(row), np.int64), buckets)
        if len(found.name):
            yield found.sent(keys, docs)

    def asked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Sorted digests of the units that rows have a fate for, and the fates."""
        blobs = batch.column("fates").to_pylist()
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, FATE)
        digest = _within(_from_low(np.ascontiguousarray(raw[:, :7]), 7), np.repeat(np.arange(len(blobs)), [len(x) // FATE for x in blobs]))
        order = np.argsort(digest)
        digest = digest[order]
        first = _groups(digest)
        return digest[first], np.bitwise_or.reduceat(raw[order, 7], first) if len(first) else raw[:0, 7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = common.text_buffers(batch.column("text"))
            keys, docs = _ids(batch)
            digest, fates = asked(batch)
            if not len(digest):
                continue
            plain, hot, held = [], [], {False: 0, True: 0}
            for found in all_runs(scheme, data, offsets):
                own = _within(_told(found.name, found.units()), found.doc)
                at = np.minimum(np.searchsorted(digest, own), len(digest) - 1)
                fate = np.where(digest[at] == own, fates[at], 0)
                sure = np.flatnonzero(fate & GONE)
                if len(sure):
                    yield _lost(keys[found.doc[sure]], found.start[sure], found.count[sure], buckets)
                for parts, some in ((plain, (fate & (OPEN | HOT)) == OPEN), (hot, fate & HOT > 0)):
                    r = np.flatnonzero(some)
                    if len(r):
                        bucket = ((found.name[r] >> U(40)) % U(buckets)).astype(np.int64)
                        hashes = found.hashes[hashing.ranges(found.at[r], found.count[r])]
                        parts.append(Open(bucket, found.name[r], found.doc[r], found.start[r], found.count[r], np.where(fate[r] & GONE, 2, 1), hashes))
                        held[parts is hot] += len(hashes)
                    if held[parts is hot] > FLUSH:
                        yield from flushed(parts, keys, docs, parts is hot)
                        held[parts is hot] = 0
            yield from flushed(plain, keys, docs, False)
            yield from flushed(hot, keys, docs, True)
        common.given_back()

    return run


def _within(told: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A unit's digest and its row in a batch, as one number."""
    return hashing.mixed(told + row.astype(np.uint64) * hashing.ODD)


def _judge_windows(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            ready = batch.filter(pa.array(kind == 1))
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(ready.column("keys").to_pylist()), np.int64)), ready.column("data")], ["key", "runs"])
            for row in batch.filter(pa.array(kind == 0)).to_pylist():
                per_doc = np.frombuffer(row["counts"], np.int32)
                key, doc = (np.repeat(np.frombuffer(row[c], np.int64), per_doc) for c in ("keys", "docs"))
                parts.append((_from_low(row["names"]), key, doc, np.frombuffer(row["weights"], np.uint8), np.frombuffer(row["starts"], np.int32), np.frombuffer(row["sizes"], np.int32), _from_low(row["data"])))
        if not parts:
            return
        name, key, doc, weight, start, count, windows = (np.concatenate([p[i] for p in parts]) for i in range(7))
        del parts
        of = np.repeat(np.arange(len(name), dtype=np.int32), count)
        content = _content(name[of], windows)
        del windows
        order = np.argsort(content)
        at = _groups(content[order])
        del content
        sizes = _sizes(at, len(order))
        if scheme.anywhere:
            gone = np.repeat(np.add.reduceat(weight[of][order], at, dtype=np.int64) > 1, sizes)
        else:
            owner = doc[of][order]
            gone = owner > np.repeat(np.minimum.reduceat(owner, at), sizes)
        removed = np.zeros(len(order), bool)
        removed[order] = gone
        hit = np.flatnonzero(removed)
        if len(hit):
            row, place = of[hit], (start[of] + hashing.ranges(np.zeros(len(count), np.int64), count))[hit]
            own = key[row]
            order = np.lexsort((place, own))
            own, place = own[order], place[order]
            new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)])
            keys, blobs = _pairs_by_key(own[new], place[new], _sizes(new, len(hit)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), common.binary_column(blobs)], ["key", "runs"])
        common.given_back()

    return run


def with_repeats(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, text and runs (blobs of pairs: first window and number of windows that are repeated, in tokens)."""
    parts = common.by_bytes(docs, "text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", common.row_key("doc_id", "text"))
    names = own.mapInArrow(_send_names(scheme, parts), NAMES)
    told = names.repartitionById(parts, "route").mapInArrow(_judge_names(scheme, parts), FATES)
    told = told.repartitionById(parts, "route").mapInArrow(_gather_fates, "key long, fates binary")
    sent = own.join(told, "key").select("key", "doc_id", "text", "fates").mapInArrow(_send_windows(scheme, parts), WINDOWS)
    lost = sent.repartitionById(parts, "route").mapInArrow(_judge_windows(scheme), "key long, runs binary")
    lost = lost.groupBy("key").agg(F.collect_list("runs").alias("runs"))
    return own.join(lost, "key", "left").select("doc_id", "text", "runs")


def bytes_of(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes()


def covered(runs: list[bytes] | None, length: int) -> list[tuple[int, int]]:
    """Maximal stretches [low, high) of tokens that lie in repeated windows, ascending."""
    pairs = np.frombuffer(b"".join(runs or ()), np.int32).reshape(-1, 2).astype(np.int64)
    low, high = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + length - 1
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]]) if len(low) else np.zeros(0, np.int64)
    return list(zip(low[new].tolist(), high[np.r_[new[1:], len(low)].astype(np.int64) - 1].tolist() if len(low) else [], strict=True))


def left_over(stretches: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What stretches leave of [0, n)."""
    edges = [0, *(x for s in stretches for x in s), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
