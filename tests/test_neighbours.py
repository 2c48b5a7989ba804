"""Neighbour graphs, exact neighbours and the spectral layout against NumPy."""

import numpy as np
import pytest

from rostrum.operators import neighbours as nb

SCHEMA = "k long, v array<double>, sim string"


def groups(seed, n, dims=12, centres=8):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims)) * 2
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))


def frame(spark, v, first=0):
    return spark.createDataFrame([(3 * i + first, x.tolist(), "clash") for i, x in enumerate(v)], SCHEMA).repartition(3)


def nearest(v, k, of=None):
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sims, -np.inf)
    return {(3 * i, 3 * int(j)): sims[i, j] for i in (of if of is not None else range(len(v))) for j in np.lexsort((np.arange(len(v)), -sims[i]))[:k]}


@pytest.mark.parametrize("blocks", [(1024, 4096), (13, 50)])
def test_exact_neighbours(spark, monkeypatch, blocks):
    for name, n in zip(("QUERIES", "BLOCK"), blocks, strict=True):
        monkeypatch.setattr(nb, name, n)
    v = groups(1, 300)
    v[40:60] = v[40]  # copies tie; the lesser key comes first
    rows = nb.valid(frame(spark, v), "k", "v")
    got = nb.exact_neighbours(rows, rows.where("key % 2 = 0"), 7).collect()
    want = nearest(v, 7, range(0, 300, 2))
    assert {(r["key"], r["other"]) for r in got} == set(want)
    assert all(abs(r["sim"] - want[r["key"], r["other"]]) < 1e-9 for r in got) and {r["rank"] for r in got} == set(range(1, 8))


@pytest.mark.parametrize("dims, centres", [(12, 8), (24, 1)])
def test_recall_of_the_descent(spark, monkeypatch, dims, centres):
    """Runs of 40 rows can't see most neighbours, so the rounds have to find them; the second table has no groups."""
    monkeypatch.setattr(nb, "RUN", 40)
    v = groups(2, 1500, dims, centres)
    points = nb.stored(nb.distinct_points(nb.valid(frame(spark, v), "k", "v")))
    want = set(nearest(v, 10))
    pairs = lambda g: {(r["key"], r["other"]) for r in g.select("key", "other").collect()}
    first = pairs(nb._top(nb._first_graph(points, 20), 10))
    graph = nb.stored(nb.neighbour_graph(points, 10))
    got = pairs(graph)
    assert len(first & want) < 0.7 * len(want) and len(got & want) >= 0.9 * len(want)
    exact = nb.exact_neighbours(points, points, 10)
    row = nb.recall(graph, exact).first()
    assert row["pairs"] == len(want) and abs(row["recall"] - len(got & want) / len(want)) < 1e-9


def test_copies_and_odd_rows(spark):
    v = groups(3, 200)
    v = np.concatenate([v, np.repeat(v[:1], 100, axis=0), 2 * v[:1]])
    odd = spark.createDataFrame([(9001, None, ""), (9002, [], ""), (9003, [0.0] * 12, ""), (9004, [float("nan")] * 12, ""), (9005, [None] * 12, ""), (None, [1.0] * 12, ""), (9006, [1.0, 2.0], ""), (9007, [float("inf")] * 12, "")], SCHEMA)
    rows = frame(spark, v).union(odd)
    points = nb.stored(nb.distinct_points(nb.valid(rows, "k", "v")))
    assert points.count() == 201  # the copies are one point, the vector of two numbers is one
    got = nb.neighbour_graph(points, 5).collect()
    assert {(r["key"], r["other"]) for r in got} == set(nearest(v[:200], 5))
    placed = {r["k"]: r["place"] for r in nb.neighbour_layout(rows, "k", "v", 5).collect()}
    assert set(placed) == {3 * i for i in range(301)} | {9006} and placed[9006] == [0.0, 0.0]
    assert len({tuple(placed[3 * i]) for i in [0, *range(200, 301)]}) == 1


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    rows = frame(spark, np.ones((n, 3)) + np.eye(3)[:n]) if n else spark.createDataFrame([], SCHEMA)
    got = nb.neighbour_layout(rows, "k", "v").collect()
    assert sorted(r["k"] for r in got) == [3 * i for i in range(n)] and all(np.isfinite(r["place"]).all() for r in got)


def test_layout_equals_eigenvectors(spark):
    v = groups(4, 150, 6, 3)
    edges = {(a // 3, b // 3): s for (a, b), s in nearest(v, 8).items()}
    w = np.zeros((150, 150))
    for (a, b), s in edges.items():
        w[a, b] = w[b, a] = max(s, 0)
    d = w.sum(axis=1)
    values, vectors = np.linalg.eigh((np.eye(150) + w / np.sqrt(d[:, None] * d)) / 2)
    graph = spark.createDataFrame([(3 * a, 3 * b, float(s)) for (a, b), s in edges.items()], "key long, other long, sim double")
    placed, found = nb.spectral_layout(graph, 2, tolerance=1e-6)
    assert np.allclose(found, values[::-1][1:3], atol=1e-6)
    place = np.array([r["place"] for r in placed.orderBy("key").collect()])
    want = vectors[:, ::-1][:, 1:3] / np.sqrt(d)[:, None] * np.sqrt(d.sum())
    for x, y in zip(place.T, want.T, strict=True):
        assert abs((d * x * y).sum() / d.sum()) > 1 - 1e-3 and x[np.abs(x).argmax()] > 0


def test_parts_come_apart(spark):
    """Three rings without a link between them: every ring is at one place of its own."""
    edges = [(100 * ring + i, 100 * ring + (i + 1) % 12, 0.9) for ring in range(3) for i in range(12)] + [(777, 778, -0.5)]
    placed, _ = nb.spectral_layout(spark.createDataFrame(edges, "key long, other long, sim double"), 2, tolerance=1e-5)
    place = {r["key"]: np.array(r["place"]) for r in placed.collect()}
    assert place[777].tolist() == place[778].tolist() == [0.0, 0.0]
    centres = [np.mean([place[100 * ring + i] for i in range(12)], axis=0) for ring in range(3)]
    assert all(np.abs(place[100 * ring + i] - centres[ring]).max() < 1e-3 for ring in range(3) for i in range(12))
    assert min(np.linalg.norm(centres[a] - centres[b]) for a in range(3) for b in range(a)) > 0.5


def test_graph_without_structure_is_exact(spark):
    """Far from each other in many dimensions, points share few neighbours: a descent finds a part of them only."""
    v = np.random.default_rng(9).normal(size=(3000, 64))
    points = nb.stored(nb.distinct_points(nb.valid(frame(spark, v), "k", "v")))
    assert {(r["key"], r["other"]) for r in nb.neighbour_graph(points, 10).collect()} == set(nearest(v, 10))


def test_descent_with_a_pool(spark):
    v = groups(6, 700)
    points = nb.stored(nb.distinct_points(nb.valid(frame(spark, v), "k", "v")))
    got = {(r["key"], r["other"]) for r in nb.neighbour_graph(points, 5, 15).collect()}
    assert len(got & set(nearest(v, 5))) >= 0.9 * len(set(nearest(v, 5)))


def shuffled(spark, job) -> int:
    """Bytes that a job's stages write to shuffles."""
    store, array = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    listed = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, array, None)
    before = listed()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, array, None)
    return sum(n for stage, n in listed().items() if stage not in before)


def test_rounds_move_values_not_edges(spark):
    """A round's shuffles have a point's values, once for each other part, however many edges it has."""
    rng = np.random.default_rng(11)
    bytes_of = {}
    for k in (10, 60):
        edges = [(i, int(j), float(s)) for i in range(3000) for j, s in zip(rng.choice(3000, k, replace=False), rng.random(k), strict=True) if i != j]
        graph = nb.stored(spark.createDataFrame(edges, "key long, other long, sim double"))
        runs = [shuffled(spark, lambda r=r, graph=graph: nb.spectral_layout(graph, 2, 0.0, r)) for r in (1, 3)]
        bytes_of[k] = (runs[1] - runs[0]) / 2 / 3000
    assert bytes_of[60] < 1.5 * bytes_of[10] < 1500


@pytest.mark.parametrize("block", [50, 1 << 16])
def test_all_points_look_both_ways(spark, monkeypatch, block):
    """All points as their own queries: the same lists as by queries of another table, and a point travels once for each block."""
    monkeypatch.setattr(nb, "BLOCK", block)
    monkeypatch.setattr(nb, "QUERIES", block)
    v = groups(12, 2600)
    points = nb.stored(nb.distinct_points(nb.valid(frame(spark, v), "k", "v")))
    found, moved = {}, {}
    for name, queries in (("same", points), ("other", points.select("*"))):
        moved[name] = shuffled(spark, lambda name=name, queries=queries: found.update({name: sorted(map(tuple, nb.exact_neighbours(points, queries, 4).select("key", "other", "rank").collect()))}))
    assert found["same"] == found["other"] and {(a, b) for a, b, _ in found["same"]} == set(nearest(v, 4))
    assert moved["same"] < 0.75 * moved["other"]
