"""Whole attacks on tables against a plain twin and the numpy kernel."""

import random

import numpy as np
import pytest

from stratagraph.operators import attack, graph, kernel

N = 26


def layer(m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted((int(rng.triangular(0, N, 0)), rng.randrange(N)))) for _ in range(m)} - {(i, i) for i in range(N)})


def plain(edges, a, b, steps):
    """One removal at a time, all scores anew."""
    near = {v: set() for v in range(N)}
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    blocked = lambda v: set(b) if v in a else set(a) if v in b else set(a) | set(b)
    alive, out = set(range(N)), []
    for _ in range(steps):
        live = lambda v: near[v] & alive if v in alive else set()
        score = {v: sum(1 + len(live(u)) for u in live(v) - blocked(v)) for v in range(N)}
        v = max(score, key=lambda x: (score[x], -x))
        if v in alive:
            alive.discard(v)
            out.append((len(out) + 1, v))
    return out


@pytest.mark.parametrize("m, seed, width, steps", [(70, 1, 3, 12), (45, 2, 256, 26), (60, 3, 1, 5), (40, 4, 6, 26)])
def test_removals(spark, m, seed, width, steps):
    edges = layer(m, seed)
    a, b = [0, 3, 5, 7], [3, 1, 9]
    seeds = lambda s: spark.createDataFrame([(x,) for x in s], "node bigint")
    nodes, arcs = spark.range(N).withColumnRenamed("id", "node"), graph.symmetric(spark.createDataFrame(edges, "u bigint, v bigint"))
    got = [tuple(r) for r in attack.removals(seeds(a), seeds(b), nodes, arcs, steps, width).orderBy("step").collect()]
    assert got == plain(edges, a, b, steps)


@pytest.mark.parametrize("weighted", [False, True])
def test_mean_influence(spark, weighted):
    edges, steps = layer(90, 8), 15
    a, b = [0, 1, 2, 4, 11], [3, 2, 9, 12]
    seeds = lambda s: spark.createDataFrame([(x,) for x in s], "node bigint")
    nodes, arcs = spark.range(N).withColumnRenamed("id", "node"), graph.symmetric(spark.createDataFrame(edges, "u bigint, v bigint"))
    rng = np.random.default_rng(1)
    w = [rng.random(N) + 0.1 for _ in range(2)] if weighted else [None, None]
    frames = [None if x is None else spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "node bigint, w double") for x in w]
    got = attack.robust(seeds(a), seeds(b), nodes, arcs, 0.2, steps, *frames, width=4).select("a", "b").collect()[0]
    g = kernel.Csr(N, *(np.array([x for e in edges for x in (e[i], e[1 - i])]) for i in (0, 1)))
    assert tuple(got) == pytest.approx(kernel.robust(g, a, b, 0.2, steps, *w), abs=1e-9)


def test_nothing_to_attack(spark):
    nodes, none = spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,)], "node bigint")
    assert [tuple(r) for r in attack.removals(seeds, seeds, nodes, none, 3).collect()] == [(1, 0)]
    assert tuple(attack.robust(seeds, seeds.limit(0), nodes, none, steps=0).collect()[0]) == (0.0, 0.0, 0.0)
    assert attack.removals(seeds, seeds, nodes.limit(0), none, 3).count() == 0


@pytest.mark.parametrize("apart", [1, 1 << 57])
def test_many_removals_take_few_rounds(spark, monkeypatch, apart):
    """Forty copies of a path with a fork, ids far apart as well: rounds follow the copies' chains, not the steps."""
    one = [(0, 1), (1, 2), (2, 3), (3, 4), (2, 5)]
    label = lambda v: v + (apart if v >= 120 else 0)
    edges = [(label(6 * k + u), label(6 * k + v)) for k in range(40) for u, v in one]
    nodes = spark.createDataFrame([(label(v),) for v in range(240)], "node bigint")
    none, arcs = spark.createDataFrame([], "node bigint"), graph.symmetric(spark.createDataFrame(edges, "u bigint, v bigint"))
    written = []
    monkeypatch.setattr(attack, "stored", lambda df, keep=attack.stored: written.append(1) or keep(df))
    got = [tuple(r) for r in attack.removals(none, none, nodes, arcs, 70, 2).orderBy("step").collect()]
    # the fork goes first everywhere, then the smaller end of each pair that is left
    assert got == [(i + 1, label(6 * i + 2)) for i in range(40)] + [(41 + i, label(3 * i)) for i in range(30)]
    assert len(written) <= 12


@pytest.mark.parametrize("contest", [0.3, 1.5])
def test_contests_of_few(spark, monkeypatch, contest):
    """Contests of the best nodes alone, one lowest score after the other, give the same order; the first has few arcs."""
    monkeypatch.setattr(attack, "FEW", 0)
    monkeypatch.setattr(attack, "CONTEST", contest)
    met = []
    keep = attack._contest
    monkeypatch.setattr(attack, "_contest", lambda arcs, *rest: met.append(arcs.count()) or keep(arcs, *rest))
    edges = layer(70, 1)
    a, b = [0, 3, 5, 7], [3, 1, 9]
    seeds = lambda s: spark.createDataFrame([(x,) for x in s], "node bigint")
    nodes, arcs = spark.range(N).withColumnRenamed("id", "node"), graph.symmetric(spark.createDataFrame(edges, "u bigint, v bigint"))
    got = [tuple(r) for r in attack.removals(seeds(a), seeds(b), nodes, arcs, 12, 3).orderBy("step").collect()]
    assert got == plain(edges, a, b, 12)
    assert met[0] < 2 * len(edges)


def test_node_tables_are_not_broadcast(spark):
    """Weights hold a row a node: a small file of them may be a large table in the driver."""
    from stratagraph.operators import influence

    nodes, arcs = spark.range(N).withColumnRenamed("id", "node"), graph.symmetric(spark.createDataFrame(layer(70, 1), "u bigint, v bigint"))
    seeds = spark.createDataFrame([(3,)], "node bigint")
    plan = influence.two_hop(seeds, nodes, arcs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not any("BroadcastExchange" in x and "w#" in x for x in plan.splitlines())
