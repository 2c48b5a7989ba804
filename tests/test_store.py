"""Tables that go with their block, and those that outlive it."""

import glob
import os

import pytest

from rostrum.operators import neighbours as nb
from rostrum.sources.store import scratch, shared_dir, stored


def tables(spark):
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*-*"))


def test_blocks(spark):
    stored(spark.range(1), "before")
    before = tables(spark)
    with scratch(spark):
        first = stored(spark.range(5), "first")
        with scratch(spark):
            stored(spark.range(6), "inner")
            second = stored(first.where("id > 1"), "second", outlives=True)
            assert len(tables(spark) - before) == 3
        assert second.count() == 3 and len(tables(spark) - before) == 2
        last = stored(second, "last", outlives=True)
    assert [os.path.basename(t)[:5] for t in tables(spark) - before] == ["last-"] and last.count() == 3
    assert before <= tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(1), "lost")
        raise ZeroDivisionError
    assert len(tables(spark) - before) == 1
    stored(spark.range(2), "after")
    assert len(tables(spark) - before) == 2


def test_descent_leaves_one_table(spark):
    points = stored(spark.createDataFrame([(i, [1.0, float(i), float(i * i % 7)]) for i in range(60)], "key long, v array<double>"))
    before = tables(spark)
    graph = nb.neighbour_graph(points, 4)
    assert len(tables(spark) - before) == 1 and graph.count() == 240
