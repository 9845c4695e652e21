"""Populations measured on what lies around their seeds, against the kernel on whole layers."""

import numpy as np
import pytest

from stratagraph.operators import evolve, graph, kernel

N = 300


def layer(seed):
    rng = np.random.default_rng(seed)
    return sorted({tuple(sorted(p)) for p in rng.integers(5, N, (420, 2)).tolist() if p[0] != p[1]})


@pytest.mark.parametrize("width, steps", [(40, 3), (1, 6)])
def test_evaluate_around(spark, width, steps):
    edges = [layer(1), layer(2)]
    one, two = (graph.symmetric(spark.createDataFrame(e, "u bigint, v bigint")) for e in edges)
    whole = [kernel.Csr(N, *(np.array([x for e in es for x in (e[i], e[1 - i])]) for i in (0, 1))) for es in edges]
    rng = np.random.default_rng(3)
    hubs = np.argsort(-np.diff(whole[0].at))[:6].tolist()
    pop = [(0, hubs[:3], hubs[3:]), (1, [7, 7, 9], [9, 0])] + [(i, rng.integers(0, N, 4).tolist(), rng.integers(0, N, 4).tolist()) for i in range(2, 7)]
    rows = spark.createDataFrame(pop, "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>")
    got = {r["id"]: (r["t1"], r["t2"], r["t3"]) for r in evolve.evaluate(rows, one, two, 0, 0.1, steps, width).collect()}
    assert got == {i: pytest.approx(kernel.tasks(*whole, x, y, 0.1, steps, steps), abs=1e-12) for i, x, y in pop}


def test_no_layer_is_sent_whole(spark):
    arcs = graph.symmetric(spark.range(0, 4000).selectExpr("id AS u", "id + 1 AS v"))
    src, _ = evolve._around(arcs, [10, 500])
    assert 0 < len(src) < 20


def test_attack_to_the_end(spark):
    """More steps than nodes with a score: the smallest node goes last, as in the kernel."""
    arcs = graph.symmetric(spark.createDataFrame([(2, 3), (3, 4)], "u bigint, v bigint"))
    pop = spark.createDataFrame([(0, [0, 3], [4])], "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>")
    whole = kernel.Csr(6, np.array([2, 3, 3, 4]), np.array([3, 2, 4, 3]))
    got = evolve.evaluate(pop, arcs, arcs, 0, 0.1, 5, 1).collect()[0]
    assert (got["t1"], got["t2"], got["t3"]) == pytest.approx(kernel.tasks(whole, whole, [0, 3], [4], 0.1, 5, 5), abs=1e-12)


def test_evaluate_leaves_nothing_behind(spark, monkeypatch):
    """What tasks were sent is given up once the scores are written."""
    arcs = graph.symmetric(spark.createDataFrame(layer(1), "u bigint, v bigint"))
    pop = spark.createDataFrame([(0, [7, 9], [9, 11])], "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>")
    held, keep = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: held.append(keep(x)) or held[-1])
    assert evolve.evaluate(pop, arcs, arcs, 5, 0.1, 2, 40).count() == 1
    assert held and not any(h._jbroadcast.isValid() for h in held)
