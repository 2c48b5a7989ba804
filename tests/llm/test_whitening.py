"""Whitened vectors against plain NumPy and whole numbers of any size."""

import math

import numpy as np
import pytest

from rostrum.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, whitened string, n long, `meta.url` string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 7, "w", 3, "u") for i, v in vectors], SCHEMA)


def brute(vectors, most=8):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    n, total = len(kept), [sum(col) for col in zip(*(x for _, x in kept), strict=True)]
    gaps = [[n * a - s for a, s in zip(x, total, strict=True)] for _, x in kept]
    y = np.array([[g / n for g in row] for row in gaps])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return [i for i, _ in kept], [sum(g * g for g in row) for row in gaps], y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def check(got, vectors, most=8):
    ids, deviation, projected, explained = brute(vectors, most)
    k = projected.shape[1]
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in got) == sorted((i is None, i or 0, d) for i, d in zip(ids, deviation, strict=True) for _ in range(k))
    for c in range(k):
        own = [r for r in got if r["component"] == c + 1]
        assert all(abs(r["explained"] - explained[c]) <= 1e-9 * explained[c] for r in own)
        found = np.array([x for _, x in sorted((r["deviation"], r["whitened"]) for r in own)])
        want = np.array([x for _, x in sorted(zip(deviation, projected[:, c], strict=True))])
        assert min(np.abs(found - want).max(), np.abs(found + want).max()) < 1e-6
    assert all(0 <= r["identity_error"] <= 1e-9 for r in got)


@pytest.mark.parametrize("dims", [3, 20])
def test_against_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(whitening, "FEWEST", 16)
    monkeypatch.setattr(whitening, "BLOCKS", 4)
    monkeypatch.setattr(whitening, "SPLIT", 2)
    monkeypatch.setattr(whitening, "COLUMNS", 8)
    rng = np.random.default_rng(dims)
    mix = rng.normal(size=(dims, dims))
    vectors = [(i * 3 % 500, (rng.normal(size=dims) @ mix).tolist()) for i in range(300)]
    vectors += [(900, None), (901, [1.0, None] + [0.0] * (dims - 2)), (902, [float("nan")] + [1.0] * (dims - 1)), (903, [float("-inf")] * dims), (None, rng.normal(size=dims).tolist())]
    vectors.append(vectors[0])
    check(whitening.whitened(frame(spark, vectors).repartition(5)).collect(), vectors)


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(size=4) * 2e6).tolist()) for i in range(40)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame(spark, vectors)).collect()}
    ids, deviation, *_ = brute(vectors)
    assert got == {i: d if d < 1 << 63 else None for i, d in zip(ids, deviation, strict=True)}


def test_long_deviations_are_null(spark):
    got = whitening.whitened(frame(spark, [(1, [1e10, 0.0]), (2, [-1e10, 1.0]), (3, [5e11, 1.0]), (4, [3e38, 1.0])])).collect()
    assert {r["vec_id"] for r in got} == {1, 2} and all(r["deviation"] is None and abs(r["identity_error"]) < 1e-6 for r in got if r["component"] == 1)


def test_no_variance(spark):
    got = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted(map(tuple, got)) == [(i, c, 2, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and all(r["explained"] == (r["component"] == 1) for r in line)


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whitened(frame(spark, vectors)).count() == 0


def test_other_lengths_go(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    check(whitening.whitened(frame(spark, vectors + [(50 + i, [1.0] * 5) for i in range(4)])).collect(), vectors)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [(r["vec_id"], r["embedding"]) for r in rows.collect()])
