"""The matrix of centralities against dense matrices and plain loops."""

import numpy as np
import pytest

from stratagraph.operators import centrality


def network(n=24):
    rng = np.random.default_rng(8)
    a = np.triu(rng.random((n, n)) < 0.15, 1)
    a[0, 1:12] = True
    a[:, n - 3 :] = False
    a[n - 3, n - 2] = True  # a part of its own, and one isolated node
    return a | a.T


def plain(a):
    """All twelve columns, the slow way."""
    n, deg = len(a), a.sum(1).astype(float)
    tri = np.diag(np.linalg.matrix_power(a.astype(int), 3)).astype(float)
    cc = np.divide(tri, deg * (deg - 1), out=np.zeros(n), where=deg > 1)
    h = [max([k for k in range(1, n) if (deg[a[i]] >= k).sum() >= k], default=0) for i in range(n)]
    core, left = np.zeros(n), np.ones(n, bool)
    for k in range(n):
        while (low := left & (a[:, left].sum(1) <= k)).any():
            core[low], left[low] = k, False
    rank = np.full(n, 1 / n)
    for _ in range(500):
        rank = 0.15 / n + 0.85 * (a.T @ np.divide(rank, deg, out=np.zeros(n), where=deg > 0) + rank[deg == 0].sum() / n)
    dist = np.full((n, n), np.inf)
    walk = np.eye(n)
    for d in range(n):
        dist[(walk > 0) & np.isinf(dist)] = d
        walk = ((walk @ a) > 0).astype(float)
    reach = np.isfinite(dist) & (dist > 0)
    total = np.where(reach, dist, 0).sum(1)
    near = np.divide(reach.sum(1) * reach.sum(1), total * (n - 1), out=np.zeros(n), where=total > 0)
    harmonic = np.where(reach, 1 / np.where(reach, dist, 1), 0).sum(1)
    mean = lambda f: np.array([np.mean(f(i)) if deg[i] else 0.0 for i in range(n)])
    nip = [deg[i] + 2 / (cc[i] + 1) * (deg[a[i]] / (cc[a[i]] + 1)).sum() for i in range(n)]
    value, vectors = np.linalg.eigh(a.astype(float))
    si = mean(lambda i: np.sqrt(deg[a[i]] ** 2 + deg[i] ** 2))
    return [deg, h, core, rank, nip, si, cc, deg / (n - 1), near, harmonic, mean(lambda i: deg[a[i]]), np.abs(vectors[:, -1])]


def tables(spark, a):
    nodes = spark.createDataFrame([(i,) for i in range(len(a))], "node bigint")
    edges = spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(np.triu(a))], "u bigint, v bigint")
    return nodes, edges


def test_twelve_columns(spark):
    a = network()
    got = centrality.columns(*tables(spark, a), 12).orderBy("node").toPandas()
    assert list(got.columns) == ["node", *centrality.COLUMNS] and len(got) == len(a)
    for name, want in zip(centrality.COLUMNS, plain(a)):
        assert got[name].to_numpy() == pytest.approx(np.array(want, float), abs=2e-5), name


@pytest.mark.parametrize("count, named, pads", [(2, 2, 0), ("many", 3, 0), (5, 3, 2), (7, 6, 1)])
def test_counts_of_columns(spark, count, named, pads):
    a = network()
    got = centrality.columns(*tables(spark, a), count)
    assert got.columns == ["node", *centrality.COLUMNS[:named], *[f"pad_{i + 1}" for i in range(pads)]]
    if pads == 1:
        rows = got.orderBy("node").toPandas()
        assert (rows["pad_1"] == 0).all()
        for name, want in zip(centrality.COLUMNS[:named], plain(a)):
            assert rows[name].to_numpy() == pytest.approx(np.array(want, float), abs=2e-5), name
