"""Stored copies after a pull: equal fields, and no more read than differs."""

import pytest

from rostrum.sources.store import fresh_path
from rostrum.sources.sync import Replica

SCHEMA = "id long, label string, score double, other string"


def replica(spark, rows, leaves=64):
    made = Replica(spark, fresh_path(spark, "replica"), "id", ["label", "score"], leaves)
    made.create(spark.createDataFrame(rows, SCHEMA))
    return made


def rows(n=400):
    return [(i, f"l{i % 9}", i / 2, f"source{i}") for i in range(n)]


def content(copy):
    return {r["id"]: tuple(r)[1:] for r in copy.read().select("id", "label", "score", "other").collect()}


def test_pull(spark):
    source = replica(spark, rows())
    read = []
    for step in (400, 40, 7, 1, 0):
        stale = [(i, "old" if step and i < step and i % 2 == 0 else None if step and i < step and i % 5 == 0 else label, score, f"mine{i}") for i, label, score, _ in rows()]
        copy = replica(spark, stale)
        changed = sum(a[1] != b[1] for a, b in zip(stale, rows(), strict=True))
        found = copy.pull(source)
        assert found["changed"] == changed and found["equal"] and found["extra"] == 0
        assert content(copy) == {i: (label, score, f"mine{i}") for i, label, score, _ in rows()}
        assert copy.pull(source) == {"buckets": 0, "read_bytes": 0, "changed": 0, "extra": 0, "equal": True}
        read.append(found["read_bytes"])
    assert read[-1] == 0 < read[3] * 20 < read[0] and read == sorted(read, reverse=True)


def test_missing_and_extra_rows(spark):
    source = replica(spark, rows(50) + [(900, None, None, "none"), (901, None, 1.5, "half")])
    mine = [(i, label, score, "m") for i, label, score, _ in rows(50)[10:]] + [(950, "only here", 1.0, "m"), (900, "kept", None, "m"), (901, "kept", 2.5, "m")]
    copy = replica(spark, mine)
    found = copy.pull(source)
    assert (found["changed"], found["extra"], found["equal"]) == (11, 3, False)
    got = content(copy)
    assert all(got[i][:2] == (f"l{i % 9}", i / 2) for i in range(50)) and got[3][2] is None
    assert got[900] == ("kept", None, "m") and got[901] == ("kept", 1.5, "m") and got[950] == ("only here", 1.0, "m")


def test_merges_keep_digests(spark):
    one, two = replica(spark, rows(60), 8), replica(spark, rows(60)[::-1], 8)
    assert one.root() == two.root() and one.differing(two) == []
    change = spark.createDataFrame([(5, "new"), (700, "added")], "id long, label string")
    one.merge(change)
    assert 1 <= len(one.differing(two)) <= 2 and one.root() != two.root()
    two.merge(change)
    assert one.root() == two.root()
    whole = replica(spark, [(r["id"], r["label"], r["score"], "x") for r in one.read().collect()], 8)
    assert whole.root() == one.root()


def test_empty(spark):
    none, some = replica(spark, []), replica(spark, rows(5))
    assert none.root() is None and none.pull(some)["equal"] and len(content(none)) == 5
    assert replica(spark, []).pull(replica(spark, []))["equal"]
    with pytest.raises(ValueError):
        none.pull(replica(spark, rows(5), 8))
