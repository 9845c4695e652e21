"""The leading eigenvector against a dense solver."""

import random

import numpy as np
import pytest

from stratagraph.operators import graph, krylov


def test_leading_eigenvector(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    arcs = graph.symmetric(spark.createDataFrame(pairs, "u bigint, v bigint"))
    nodes = spark.range(32).withColumnRenamed("id", "node")  # two without arcs
    a = np.zeros((32, 32))
    for u, v in pairs:
        a[u, v] = a[v, u] = 1
    values, vectors = np.linalg.eigh(a)
    x, value, residual = krylov.leading(nodes, arcs, 1e-7)
    got = np.array([r["x"] for r in x.orderBy("node").collect()])
    assert value == pytest.approx(values[-1]) and residual <= 1e-7 * value
    assert np.allclose(got, np.abs(vectors[:, -1]), atol=1e-5)
    assert np.linalg.norm(a @ got - value * got) <= 1e-5


def test_without_arcs(spark):
    nodes = spark.range(4).withColumnRenamed("id", "node")
    arcs = spark.createDataFrame([], "src bigint, dst bigint")
    x, value, _ = krylov.leading(nodes, arcs)
    assert value == 0.0 and [r["x"] for r in x.collect()] == [0.5] * 4
    assert krylov.leading(nodes.limit(0), arcs)[0].count() == 0


def test_a_step_writes_once_and_deals_no_arcs_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(krylov, "stored", lambda df, keep=krylov.stored: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    arcs = graph.symmetric(spark.createDataFrame([(i, i + 1) for i in range(8)] + [(0, 5), (2, 7)], "u bigint, v bigint"))
    x, value, _ = krylov.leading(spark.range(10).withColumnRenamed("id", "node"), arcs)
    assert 1 < len(written) <= 10
    assert "InMemoryTableScan" in written[-1]


def test_positions_without_the_layer_on_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from stratagraph.operators import spectral

    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(70)} | {(i, i + 1) for i in range(24)})
    arcs = graph.symmetric(spark.createDataFrame(pairs, "u bigint, v bigint"))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("through the driver"))
    got = spectral.positions(spark.range(26).withColumnRenamed("id", "node"), arcs, 3, 2000).orderBy("node").collect()
    x = np.array([r["position"] for r in got])
    a = np.zeros((26, 26))
    for u, v in pairs:
        a[u, v] = a[v, u] = 1
    scale = 1 / np.sqrt(np.maximum(a.sum(1), 1))
    a = scale[:, None] * a * scale
    values = np.sort(np.linalg.eigvalsh(a))[::-1][1:4]
    assert (x[25] == 0).all() and np.allclose(x.T @ x, np.eye(3)) and np.allclose(a @ x, x * values, atol=1e-3)
