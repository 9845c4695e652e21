"""Searches over all nodes against sequential and recomputing twins."""

import math
import random
from itertools import combinations

import pytest

from stratagraph import session
from stratagraph.functions import softmax
from stratagraph.operators import celf, graph, search, swaps, walks


def network(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return graph.symmetric(spark.createDataFrame(sorted(pairs), "u bigint, v bigint"))


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def greedy_twin(n, live, sims):
    """Labels one node at a time, every gain recomputed."""
    reach = {}
    for v in range(n):
        got = set()
        for (_, s), arcs in live.items():
            todo, seen = [v], {v}
            while todo:
                for d in arcs.get(todo.pop(), ()):
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            got |= {(s, x) for x in seen}
        reach[v] = got | {(s, v) for s in range(sims)}
    out, covered = {}, set()
    for pos in range(1, n + 1):
        best = max((v for v in range(n) if v not in out), key=lambda v: (len(reach[v] - covered), -v))
        out[best] = (len(reach[best] - covered) / sims, pos)
        covered |= reach[best]
    return out


@pytest.mark.parametrize("p, sims", [(0.3, 5)])
def test_labels_of_all_nodes(spark, p, sims):
    layers = {1: network(spark, 40, 70, 1), 2: network(spark, 40, 50, 2)}
    live = {}
    for r in walks.live_arcs(layers, p, sims).collect():
        live.setdefault((r["layer"], r["sim"]), {}).setdefault(r["src"], []).append(r["dst"])
    got = {r["node"]: (r["label"], r["pos"]) for r in celf.labels(nodes(spark, 40), layers, p, sims).collect()}
    assert got == greedy_twin(40, live, sims)


def test_labels_without_arcs(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    got = [tuple(r) for r in celf.labels(nodes(spark, 3), {1: none}, 0.5, 4).orderBy("pos").collect()]
    assert got == [(0, 1.0, 1), (1, 1.0, 2), (2, 1.0, 3)]
    assert celf.labels(nodes(spark, 0), {1: none}, 0.5, 4).count() == 0


def written(monkeypatch, *modules):
    """Rows of each table that the modules write from now on."""
    rows, plain = [], session.stored

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    for module in modules:
        monkeypatch.setattr(module, "stored", counted)
    return rows


def test_reach_is_written_once_and_read_where_paths_go_on(spark, monkeypatch):
    rng = random.Random(4)
    arcs = {tuple(rng.sample(range(90), 2)) for _ in range(110)} | {(100 + i, 101 + i) for i in range(9)}
    reach = {a: {b for x, b in arcs if x == a} for a in range(120)}
    for _ in range(120):
        reach = {a: set().union(b, *(reach[m] for m in b)) for a, b in reach.items()}
    want = {(0, a, b) for a, far in reach.items() for b in far if a != b}
    rows = written(monkeypatch, celf)
    got = celf.reach_pairs({1: spark.createDataFrame(sorted(arcs), "src bigint, dst bigint")}, 1.0, 1)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)
    assert sum(rows) < 4 * len(want)


@pytest.mark.parametrize("few, sent", [(0, 0), (0, 100), (1_000, 100)])
def test_greedy_cascade_keeps_no_pairs_of_a_node_with_itself(spark, monkeypatch, few, sent):
    layers = {k: spark.createDataFrame([(a, b) for a in range(30) for b in range(30) if a != b and (a * 7 + b * k) % 5 == 0], "src bigint, dst bigint") for k in (1, 2)}
    sims, coins = 6, {(r["sim"], r["layer"], r["src"], r["dst"]) for r in walks.live_arcs(layers, 0.2, 6).collect()}
    reach = {o: {(s, o) for s in range(sims)} for o in range(400)}
    for s in range(sims):
        for layer in layers:
            for o in range(30):
                seen, edge = {o}, [o]
                while edge:
                    edge = [d for s2, k, a, d in coins if s2 == s and k == layer and a in edge and d not in seen]
                    seen |= set(edge)
                reach[o] |= {(s, n) for n in seen}
    want, held, covered = [], set(), set()
    for i in range(3):
        best = max((o for o in reach if o not in held), key=lambda o: (len(reach[o] - covered), -o))
        want.append((i + 1, best, len(reach[best] - covered) / sims))
        held.add(best)
        covered |= reach[best]
    monkeypatch.setattr(walks, "FEW", few, raising=False)
    monkeypatch.setattr(walks, "SENT", sent, raising=False)
    rows = written(monkeypatch, walks, celf)
    got = walks.greedy_cascade(nodes(spark, 400), layers, 0.2, sims, 3).collect()
    assert [(r["pos"], r["node"], pytest.approx(r["gain"])) for r in got] == want
    if not few:
        assert max(rows) < 400 * sims


def sides(spark, n=24, k=4):
    out, plain = [], []
    for seed in (3, 4):
        rng = random.Random(seed)
        zones = search.zones(nodes(spark, n), network(spark, n, 34, seed))
        value = {i: rng.randint(1, 64) / 8 for i in range(n)}  # exact in binary, so that sums can't differ by order
        chosen = sorted(rng.sample(range(n), k))
        table = spark.createDataFrame(list(value.items()), "node bigint, value double")
        out.append(swaps.Side.of(zones, table, spark.createDataFrame([(i,) for i in chosen], "node bigint")))
        zone = {}
        for r in zones.collect():
            zone.setdefault(r["src"], set()).add(r["dst"])
        plain.append((zone, value, chosen))
    return out, plain


def worth(zone, value, seeds):
    return sum(value[m] for m in set().union(*[zone.get(s, set()) for s in seeds]))


def test_fill_gaps(spark):
    pair, plain = sides(spark)
    got = [tuple(r) for r in swaps.fill_gaps(*pair, weight=0.5).orderBy("step").collect()]
    now = [list(s) for _, _, s in plain]
    score = lambda lists: swaps.fitness(*[worth(z, v, s) for (z, v, _), s in zip(plain, lists)], 0.5)
    want = [(0, None, None, None, score(now))]
    while True:
        tried = []
        for k in (0, 1):
            for s in now[k]:
                for c in set(range(24)) - set(now[k]):
                    lists = [list(x) for x in now]
                    lists[k] = [c if x == s else x for x in lists[k]]
                    tried.append((score(lists), -k, worth(*plain[k][:2], lists[k]), -s, -c))
        best = max(tried)
        if best[0] - score(now) <= 1e-6:
            break
        k, s, c = -best[1], -best[3], -best[4]
        now[k] = [c if x == s else x for x in now[k]]
        want.append((len(want), 1 + k, s, c, score(now)))
    assert len(want) > 2
    assert [r[:4] + r[6:] for r in got] == want
    for side, seeds in zip(pair, now):
        assert side.seeds == sorted(seeds)
        zone, value, _ = plain[pair.index(side)]
        held = {r["node"]: (r["n"], r["who"]) for r in side.cover.collect()}
        assert held == {m: (sum(m in zone[s] for s in seeds), sum(s for s in seeds if m in zone[s])) for s_ in seeds for m in zone[s_]}


def test_two_swaps(spark):
    pair, plain = sides(spark)
    one = swaps.two_swap_across(*pair, weight=0.5).collect()[0]
    best = max(
        swaps.fitness(worth(*plain[0][:2], [b if x == a else x for x in plain[0][2]]), worth(*plain[1][:2], [d if x == c else x for x in plain[1][2]]), 0.5)
        for a in plain[0][2] for b in set(range(24)) - set(plain[0][2]) for c in plain[1][2] for d in set(range(24)) - set(plain[1][2])
    )
    assert one["fitness"] == best
    for side, (zone, value, seeds) in zip(pair, plain):
        base = worth(zone, value, seeds)
        free = sorted(set(range(24)) - set(seeds))
        tried = {}
        for outs in combinations(seeds, 2):
            for ins in combinations(free, 2):
                tried[(*outs, *ins)] = worth(zone, value, [s for s in seeds if s not in outs] + list(ins)) - base
        want = min(tried.items(), key=lambda x: (-x[1], x[0]))
        assert [tuple(r) for r in swaps.two_swap_within(side).collect()] == [(*want[0], want[1])]


def test_two_swaps_have_no_row_a_node_for_every_two_seeds(spark, monkeypatch):
    n, held = 200, [3, 10, 50, 120, 160, 199]
    zones = search.zones(nodes(spark, n), network(spark, 12, 14, 3))
    value = spark.createDataFrame([(i, float(i * i + 1)) for i in range(n)], "node bigint, value double")
    side = swaps.Side.of(zones, value, spark.createDataFrame([(i,) for i in held], "node bigint"))
    zone = {}
    for r in side.zones.collect():
        zone.setdefault(r["src"], set()).add(r["dst"])
    worth = lambda seeds: sum(i * i + 1.0 for i in set().union(*(zone[s] for s in seeds)))
    far = [i for i in range(n) if i not in held and (i < 13 or i > 190)]
    want = max((worth([s for s in held if s not in outs] + list(ins)) - worth(held), *(-x for x in outs + ins)) for outs in combinations(held, 2) for ins in combinations(far, 2))
    monkeypatch.setattr(swaps, "TRIED", 4, raising=False)
    rows = written(monkeypatch, swaps)
    got = [tuple(r) for r in swaps.two_swap_within(side).collect()]
    assert got == [(*(-x for x in want[1:]), want[0])]
    assert max(rows) < 5 * n  # a row a node for each of 15 pairs would be 2,910


def test_small_sides(spark):
    zones = search.zones(nodes(spark, 3), network(spark, 3, 2, 1))
    value = spark.createDataFrame([(i, 1.0) for i in range(3)], "node bigint, value double")
    full = swaps.Side.of(zones, value, nodes(spark, 3))
    assert full.exchanges().count() == 0 and swaps.fill_gaps(full, full).count() == 1
    single = swaps.Side.of(zones, value, nodes(spark, 1))
    assert swaps.two_swap_within(single).count() == 0
    with pytest.raises(ValueError):
        swaps.fill_gaps(full, full, weight=2.0)


def test_softmax(spark):
    rows = [("a", 1000.0), ("a", 1001.0), ("b", -5.0), (None, 2.0), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {}
    for r in softmax(df, "x", ["k"]).collect():
        got.setdefault(r["k"], []).append(r["share"])
    assert sorted(got["a"]) == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and got["b"] == [1.0]
    assert got[None] == pytest.approx([0.5, 0.5]) and got["c"] == [None]
    whole = [r["share"] for r in softmax(df.filter("x > 0"), "x", [], temperature=10.0, log=True).collect()]
    assert sum(math.exp(v) for v in whole) == pytest.approx(1.0)
    assert softmax(df.limit(0), "x", ["k"]).count() == 0
