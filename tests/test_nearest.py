"""The nearest rows of one part in another against plain loops."""

import numpy as np
import pytest

from rostrum.operators import nearest as ne


@pytest.mark.parametrize("far", [0.0, 1e4])
@pytest.mark.parametrize("euclidean", [True, False])
def test_nearest(monkeypatch, euclidean, far):
    """Copies, one row far from all others, strips and columns that end anywhere."""
    monkeypatch.setattr(ne, "STRIP", 17)
    monkeypatch.setattr(ne, "ACROSS", 29)
    monkeypatch.setattr(ne, "MEASURED", 100)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 6))
    v[100:130] = v[3]
    v[7] += far
    keys = rng.permutation(1000)[:150]
    cost = (lambda a, b: ne.euclidean(a, b, 9)) if euclidean else (lambda a, b: -np.round((a * b).sum(axis=1), 9))
    want = {}
    for i in range(60):
        d = cost(np.broadcast_to(v[i], v.shape), v)
        want[keys[i]] = [x for x in sorted(zip(d.tolist(), keys.tolist(), strict=True)) if euclidean or x[1] != keys[i]][:5]
    got: dict = {}
    for key, other, far_ in ne.nearest(keys[:60], v[:60], keys, v, 5, cost, euclidean, euclidean):
        for a, b, c in zip(key.tolist(), other.tolist(), far_.tolist(), strict=True):
            got.setdefault(a, []).append((c, b))
    assert {int(k): x for k, x in got.items()} == {int(k): x for k, x in want.items()}


def test_a_point_travels_once_per_block():
    """Copies of a table that travel: as many up to half a million rows, then one more for every 65,536."""
    assert [ne.parts(n, 1 << 16) for n in (0, 500, 10_256, 102_564, 524_288, 615_384)] == [1, 1, 8, 8, 8, 10]
