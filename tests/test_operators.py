"""Hand-computed cases on the path 0-1-2-3, and plain-Python twins on random graphs."""

import numpy as np
import pytest

from stratagraph.operators import attack, centrality, evolve, graph, influence, ranking, search
from stratagraph.operators.kernel import Csr, robust
from stratagraph.sources import edgelist


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "u bigint, v bigint")


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def seeds(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


def twin(own, other, adj, alive, p, w):
    """The two-hop formula as a loop over lists."""
    total = 0.0
    for s in own:
        total += w[s]
        if not alive[s]:
            continue
        for j in adj[s]:
            if not alive[j] or j in other:
                continue
            total += p * w[j] + p * p * sum(w[k] for k in adj[j] if alive[k] and k not in other)
            if j in own:
                deg = sum(alive[k] for k in adj[j])
                for k in adj[j]:
                    if alive[k] and k in other:
                        deg //= 2
                total -= p * w[j] * (1 + p * deg)
    return total


def test_path_structure(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (2, 3)]), nodes(spark, 5)
    arcs = graph.symmetric(e)
    assert {r["node"]: r["deg"] for r in graph.degree(n, arcs).collect()} == {0: 1, 1: 2, 2: 2, 3: 1, 4: 0}
    assert {(r["src"], r["dst"]) for r in graph.two_hop(arcs).collect()} == {(0, 2), (2, 0), (1, 3), (3, 1)}
    assert graph.triangles(e).count() == 0


def test_two_hop_by_hand(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (2, 3)]), nodes(spark, 4)
    got = influence.two_hop(seeds(spark, [1]), n, graph.symmetric(e), 0.1).collect()[0][0]
    assert got == pytest.approx(1 + 0.1 * 2 + 0.01 * 3)


def test_repeated_and_empty_seeds(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (2, 3)]), nodes(spark, 4)
    arcs = graph.symmetric(e)
    one = influence.two_hop(seeds(spark, [1]), n, arcs, 0.1).collect()[0][0]
    assert influence.two_hop(seeds(spark, [1, 1]), n, arcs, 0.1).collect()[0][0] == pytest.approx(2 * one)
    assert influence.two_hop(seeds(spark, [0]).limit(0), n, arcs).collect()[0][0] == 0.0


def test_competition_and_attacks_match_twins(spark):
    rng = np.random.default_rng(5)
    n = 24
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (60, 2)) if a != b})
    adj = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in range(n)}
    a, b = [0, 1, 2, 5], [2, 3, 7]
    arcs = graph.symmetric(edges(spark, pairs))
    alive = [True] * n
    alive[4] = alive[5] = False
    ones = [1.0] * n
    row = influence.competitive(seeds(spark, a), seeds(spark, b), nodes(spark, n), arcs, 0.1, removed=seeds(spark, [4, 5])).collect()[0]
    assert row["a"] == pytest.approx(twin(a, set(b), adj, alive, 0.1, ones))
    assert row["b"] == pytest.approx(twin(b, set(a), adj, alive, 0.1, ones))
    src = np.array([x for x, y in pairs] + [y for x, y in pairs])
    dst = np.array([y for x, y in pairs] + [x for x, y in pairs])
    mean = influence.robust_plan(seeds(spark, a), seeds(spark, b), nodes(spark, n), arcs, 0.1, 3).collect()[0]
    one = attack.robust(seeds(spark, a), seeds(spark, b), nodes(spark, n), arcs, 0.1, steps=3).collect()[0]
    assert tuple(one) == pytest.approx(tuple(mean))
    got = robust(Csr(n, src, dst), a, b, 0.1, 3)
    assert got == pytest.approx((mean["a"], mean["b"]))


def test_edge_list_text(spark):
    text = ["junk", "layer:1 nodes=4 edges=3", "0 1", "1 0", "", "1 2", "1 2 3", "layer:2 nodes=4 edges=1", "0 3"]
    lines = spark.createDataFrame([("007_sw_12_2_9", i, t) for i, t in enumerate(text)], "graph string, line_no int, line string")
    got = sorted(tuple(r) for r in edgelist.parse(lines).select("layer", "u", "v").collect())
    assert got == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    assert edgelist.node_counts(lines).collect()[0]["n_nodes"] == 12


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "net.txt")
    layers = {1: edges(spark, [(0, 1), (1, 2)]), 2: edges(spark, [(0, 2)])}
    edgelist.write(layers, nodes(spark, 3), path)
    got = edgelist.parse(edgelist.read(spark, path)).select("layer", "u", "v").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (1, 1, 2), (2, 0, 2)]


def test_ranks_and_survival(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(-i), float(i * i % 7)) for i in range(20)], "id bigint, t1 double, t2 double, t3 double")
    ranked = ranking.skill_factors(df, ["t1", "t2", "t3"])
    assert sorted(r["rank_t1"] for r in ranked.collect()) == list(range(1, 21))
    stay = ranking.survival(ranked.withColumnRenamed("t1", "cost"), 7).collect()
    assert len(stay) == 7


def test_greedy_covers_a_star(spark):
    e, n = edges(spark, [(0, i) for i in range(1, 6)]), nodes(spark, 7)
    w = n.selectExpr("node", "1.0D as w")
    assert [r["node"] for r in search.greedy(n, graph.symmetric(e), w, 2).orderBy("pos").collect()] == [1, 0]


def test_search_never_gets_worse(spark):
    n = 30
    arcs = graph.symmetric(edges(spark, [(i, (i * 7 + 3) % n) for i in range(n) if i < (i * 7 + 3) % n]))
    w = nodes(spark, n).selectExpr("node", "1.0D as w")
    rows = evolve.search(spark, n, arcs, arcs, w, w, size=6, generations=2, k=3, steps=2).orderBy("gen").collect()
    assert len(rows) == 3
    for t in ("best_t1", "best_t2", "best_t3"):
        assert all(x[t] <= y[t] + 1e-12 for x, y in zip(rows, rows[1:]))


def test_core_numbers_by_peeling(spark):
    """A long chain on a clique needs a round for each of its links; core numbers come from removing least degrees."""
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(30)] + [(a, b) for a in range(30, 35) for b in range(a + 1, 35)]
    pairs += [(int(a), int(b)) for a, b in {tuple(sorted(p)) for p in rng.integers(35, 60, (60, 2)).tolist()} if a != b]
    adj = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(62)}
    want, k = {}, 0
    while adj:
        i = min(adj, key=lambda x: len(adj[x]))
        k = max(k, len(adj[i]))
        want[i] = k
        for j in adj.pop(i):
            adj[j].discard(i)
    got = {r["node"]: r["core"] for r in centrality.core_numbers(nodes(spark, 62), graph.symmetric(edges(spark, pairs))).collect()}
    assert got == want


def test_lines_of_a_graph_go_to_many_tasks(spark):
    """Layers of graphs whose lines are far apart; no window over a graph."""
    rows = [(g, i, "x" if i == 0 else f"layer:{i // 50} nodes=9 edges=9" if i % 50 == g else f"{i} {i + 1}") for g in range(3) for i in range(400)]
    lines = spark.createDataFrame([(str(g), i, s) for g, i, s in rows], "graph string, line_no int, line string").repartition(5)
    want, layer = set(), {}
    for g, i, s in rows:
        layer[g] = layer.get(g, 0) + s.startswith("layer:")
        if layer[g] and len(s.split()) == 2:
            want.add((str(g), layer[g], i, i + 1))
    got = edgelist.parse(lines)
    assert {tuple(r) for r in got.collect()} == want
    assert "windowspecdefinition(graph" not in got._jdf.queryExecution().executedPlan().toString()


def test_whole_closeness_by_search(spark):
    """Every node, and all distances: a chain far beyond three hops, a random part and isolated nodes."""
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(20)] + list({tuple(sorted(p)) for p in rng.integers(30, 120, (110, 2)).tolist() if p[0] != p[1]})
    adj = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(130)}
    got = {r["node"]: r for r in centrality.whole_closeness(nodes(spark, 130), graph.symmetric(edges(spark, pairs))).collect()}
    assert len(got) == 130
    for i in adj:
        dist, front = {i: 0}, [i]
        for a in front:
            for b in adj[a] - dist.keys():
                dist[b] = dist[a] + 1
                front.append(b)
        far = [d for d in dist.values() if d]
        assert got[i]["closeness"] == pytest.approx(len(far) ** 2 / sum(far) / 129 if far else 0)
        assert got[i]["harmonic"] == pytest.approx(sum(1 / d for d in far))


def test_spread_in_stretches_and_blocks(monkeypatch):
    for name, value in (("SLOTS", 3), ("STRETCH", 8), ("ROWS", 16)):
        monkeypatch.setattr(centrality, name, value)
    rng = np.random.default_rng(3)
    a = np.triu(rng.random((70, 70)) < 0.06, 1)
    a[5, 8:60] = True
    a[np.arange(69), np.arange(1, 70)] = True
    a |= a.T
    own, to = np.nonzero(a)
    place, slots, more = centrality._slots(to, own, 70)
    got = [s[place] for s in centrality._spread(slots, more, 70, place[10:])]
    dist = np.full((70, 70), 70)
    walk = np.eye(70)
    for d in range(70):
        dist[(walk > 0) & (dist == 70)] = d
        walk = ((walk @ a) > 0).astype(float)
    far = dist[10:].astype(float)
    far[far == 0] = np.inf
    assert len(more) > 3
    assert (got[0] == np.isfinite(far).sum(0)).all() and (got[1] == dist[10:].sum(0)).all() and np.allclose(got[2], (1 / far).sum(0))


def test_whole_closeness_in_shares(spark, monkeypatch):
    """A component in several shares, a hub, small components together."""
    for name, value in (("SOURCES", 64), ("SHARE", 50)):
        monkeypatch.setattr(centrality, name, value)
    rng = np.random.default_rng(6)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 180, (260, 2)).tolist() if p[0] != p[1]} | {(7, i) for i in range(8, 90)}
    pairs |= {(200 + 3 * i, 201 + 3 * i) for i in range(30)} | {(i, i + 1) for i in range(300, 420)}
    adj = {i: set() for i in range(430)}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    got = {r["node"]: r for r in centrality.whole_closeness(nodes(spark, 430), graph.symmetric(edges(spark, list(pairs)))).collect()}
    for i in adj:
        dist, front = {i: 0}, [i]
        for a in front:
            for b in adj[a] - dist.keys():
                dist[b] = dist[a] + 1
                front.append(b)
        far = [d for d in dist.values() if d]
        assert got[i]["closeness"] == pytest.approx(len(far) ** 2 / sum(far) / 429 if far else 0)
        assert got[i]["harmonic"] == pytest.approx(sum(1 / d for d in far))


def test_whole_closeness_has_no_limit_of_arcs(spark, monkeypatch):
    monkeypatch.setattr(influence, "MAX_ARCS", 2)
    monkeypatch.setattr(centrality, "MAX_ARCS", 2, raising=False)
    got = {r["node"]: r["harmonic"] for r in centrality.whole_closeness(nodes(spark, 4), graph.symmetric(edges(spark, [(0, 1), (1, 2)]))).collect()}
    assert got == {0: 1.5, 1: 2.0, 2: 1.5, 3: 0.0}


def test_pairs_go_on_until_there_are_enough(spark):
    from stratagraph.operators import sampling

    got = {tuple(r) for r in sampling.drawn_pairs(spark, 6, 100, "t", edges(spark, [(0, 1), (2, 3)])).collect()}
    assert got == {(u, v) for u in range(6) for v in range(u + 1, 6)} - {(0, 1), (2, 3)}


def test_steps_round_half_to_even():
    assert [influence.steps_of(n, None, 0.1) for n in (5, 15, 25, 100)] == [0, 2, 2, 10]
    assert influence.steps_of(7) == 7 and influence.steps_of(7, 3, 0.5) == 3


def test_running_sums_keep_ties_apart(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "id bigint, x double")
    got = [r["id"] for r in ranking.ordinal(rows, "x").orderBy("rank").collect()]
    assert got == sorted(range(50), key=lambda i: (-(i % 3), i))
