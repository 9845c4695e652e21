"""Positions on a layer of many parts are exact, whatever its size."""

import numpy as np
import pytest

from stratagraph.operators import graph, spectral


def test_positions_of_components(spark, monkeypatch):
    monkeypatch.setattr(spectral, "MAX_ARCS", 3)
    rng = np.random.default_rng(2)
    pairs = {(8 * c + i, 8 * c + i + 1) for c in range(6) for i in range(c + 1)}
    pairs |= {tuple(sorted(p)) for p in rng.integers(40, 47, (9, 2)).tolist() if p[0] != p[1]}
    arcs = graph.symmetric(spark.createDataFrame(sorted(pairs), "u bigint, v bigint"))
    rows = spectral.positions(spark.range(50).withColumnRenamed("id", "node"), arcs, 4).orderBy("node").collect()
    assert [r["node"] for r in rows] == list(range(50))
    x = np.array([r["position"] for r in rows])
    a = np.zeros((50, 50))
    for u, v in pairs:
        a[u, v] = a[v, u] = 1
    deg = a.sum(1)
    scale = 1 / np.sqrt(np.maximum(deg, 1))
    assert (x[deg == 0] == 0).all() and np.allclose(x.T @ x, np.eye(4)) and np.allclose(np.sqrt(deg) @ x, 0)
    assert np.allclose(scale[:, None] * a * scale @ x, x)


def test_few_components_are_still_checked(spark, monkeypatch):
    monkeypatch.setattr(spectral, "MAX_ARCS", 3)
    arcs = graph.symmetric(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u bigint, v bigint"))
    with pytest.raises(ValueError):
        spectral.positions(spark.range(4).withColumnRenamed("id", "node"), arcs, 2)
