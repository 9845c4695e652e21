"""The discrepancy of many graphs against a plain loop over them."""

import tracemalloc

import numpy as np
import pytest

from stratagraph.operators import blocks, losses


def shares(rows, most):
    """(vectors, weights) of one side of a graph, the plain way."""
    rows = [(i, z, max(w or 0.0, 0.0)) for i, z, w in rows if z is not None]
    total = sum(r[2] for r in rows)
    rows = [(i, z, w / total if total > 0 else 1 / len(rows)) for i, z, w in rows]
    if most:
        rows = sorted(rows, key=lambda r: (-r[2], r[0]))[:most]
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def kernel(x, y):
    d2 = ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)
    return sum(np.exp(-d2 / (2 * s * s)) for s in losses.SIGMAS) / len(losses.SIGMAS)


def sides(seed):
    rng = np.random.default_rng(seed)
    made = []
    for side in range(2):
        rows = []
        for graph, n in (("big", 70), ("small", 4), ("zero", 6), ("negative", 5), (f"only {side}", 3), (None, 2)):
            for i in range(n):
                w = {"zero": 0.0, "negative": -1.0}.get(graph, float(rng.normal() + 0.5))
                rows.append((graph, len(rows), [float(v) for v in rng.normal(side * 0.3, 1, 5)], w))
        rows += [("big", 900, None, 3.0), ("small", 901, [0.0] * 5, None)]
        made.append(rows)
    return made


@pytest.mark.parametrize("most, block", [(0, blocks.BLOCK), (0, 16), (5, 16)])
def test_discrepancy_of_graphs(spark, monkeypatch, most, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    made = sides(seed=most)
    frames = [spark.createDataFrame(rows, "graph string, idx bigint, z array<double>, w double") for rows in made]
    got = {r["graph"]: r["ammd"] for r in losses.discrepancy_of_graphs(*frames, most=most).collect()}
    assert set(got) == {"big", "small", "zero", "negative"}
    for graph, value in got.items():
        (x, u), (y, v) = (shares([r[1:] for r in rows if r[0] == graph], most) for rows in made)
        assert value == pytest.approx(u @ kernel(x, x) @ u + v @ kernel(y, y) @ v - 2 * u @ kernel(x, y) @ v, abs=1e-9)
    mean = losses.mean_discrepancy(*frames, most=most).collect()[0]
    assert mean["graphs"] == 4 and mean["ammd"] == pytest.approx(sum(got.values()) / 4)


def test_weighted_samples_and_no_graphs(spark):
    made = sides(seed=9)
    frames = [spark.createDataFrame(rows, "graph string, idx bigint, z array<double>, w double") for rows in made]
    rows = losses._graph_shares(frames[0], 5, "weighted", "p").groupBy("graph").count().collect()
    assert {r["graph"]: r["count"] for r in rows} == {"big": 5, "small": 5, "zero": 5, "negative": 5, "only 0": 3}
    drawn = losses._graph_shares(frames[0], 5, "weighted", "p").filter("graph = 'big'").collect()
    assert all(r["w"] > 0 for r in drawn)
    with pytest.raises(ValueError):
        losses._graph_shares(frames[0], 5, "other", "p")
    assert [tuple(r) for r in losses.mean_discrepancy(frames[0].limit(0), frames[1]).collect()] == [(0.0, 0)]


def test_kernel_sums_hold_a_strip_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    p, q = rng.normal(size=(1500, 8)), rng.normal(size=(1300, 8))
    u, v = rng.random(1500), rng.random(1300)
    d2 = ((p[:, None, :] - q[None, :, :]) ** 2).sum(2)
    want = float(u @ (sum(np.exp(-d2 / (2 * s * s)) for s in losses.SIGMAS) / len(losses.SIGMAS)) @ v)
    del d2
    tracemalloc.start()
    try:
        got = losses._kernel_sum(p, u, q, v)
        assert tracemalloc.get_traced_memory()[1] < 8e6
    finally:
        tracemalloc.stop()
    assert got == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(losses, "TILE", 1)  # a row at a time
    assert losses._kernel_sum(p, u, q, v) == pytest.approx(want, rel=1e-12)
