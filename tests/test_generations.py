"""Guided generations against a plain twin that takes one candidate at a time."""

import hashlib
import math
import random

import numpy as np
import pytest

from stratagraph.operators import generations, graph, kernel

N, BUDGETS = 24, (4, 3)
RATES = generations.Rates(crossing=0.8, across=0.5, guided=0.8, share=0.5, random=0.3, near=0.3, tries=3)


def u(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 4294967296.0


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    w = [{v: rng.choice([0.5, 1.0, 2.0, 3.5]) for v in range(N)} for _ in range(2)]
    to = [{v: rng.randrange(N) for v in range(0, N, 2)} | {1: 99} for _ in range(2)]  # 99 isn't on the other layer
    near = [{v: rng.sample([x for x in range(N) if x != v], 4) for v in range(N - 3)} for _ in range(2)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    guide = generations.Guide(
        tuple(frame(sorted(x.items()), "node bigint, w double") for x in w),
        tuple(frame(sorted(x.items()), "a bigint, b bigint") for x in to),
        tuple(frame([(a, b) for a, bs in x.items() for b in bs], "a bigint, b bigint") for x in near),
    )
    rows = [(i, rng.sample(range(N), 4), rng.sample(range(N), 3), 1 + i % 3, 1.0 / (1 + i // 2)) for i in range(9)]
    rows[3] = (3, [], [5, 6, 7], 1, 0.5)  # an empty side
    rows[4] = (4, [1, 77, 2, 3], [1, 1, 2], 2, 0.25)  # a gene of no layer, a gene twice
    pop = frame(rows, "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>, skill int, fitness double")
    return guide, pop, rows, w, to, near


def contest(pair, members, purpose):
    """Members are (id, skill, fitness) in slot order."""
    n = len(members)
    one = int(u(f"{purpose}:0", pair) * n)
    two = (one + 1 + int(u(f"{purpose}:1", pair) * max(n - 1, 1))) % n
    a, b = members[one], members[two]
    return b if b[2] > a[2] else a


def plain_parents(rows, pairs, across, purpose):
    order = sorted(((r[0], r[3], r[4]) for r in rows), key=lambda r: (r[1], r[0]))
    skills = sorted({r[1] for r in order})
    of = {s: [r for r in order if r[1] == s] for s in skills}
    out = []
    for p in range(pairs):
        m = len(skills)
        i = int(u(f"{purpose}:one", p) * m)
        j = (i + 1 + int(u(f"{purpose}:two", p) * max(m - 1, 1))) % m
        apart = u(f"{purpose}:apart", p) < across and m > 1
        x = contest(p, of[skills[i]] if apart else order, f"{purpose}:x")
        y = contest(p, of[skills[j]] if apart else of[x[1]], f"{purpose}:y")
        out.append((p, x[0], x[1], y[0], y[1]))
    return out


def plain_children(rows, pairs, w, to, purpose, first_id):
    by_id = {r[0]: [[g for g in r[1] if g < N], [g for g in r[2] if g < N]] for r in rows}
    spare = [sorted(sorted(range(N), key=lambda v: (u(f"{purpose}:reserve", s, v), v))[: 2 * k]) for s, k in enumerate(BUDGETS)]
    out = []
    for p, x, sx, y, sy in pairs:
        mode = "copy" if u(f"{purpose}:mating:cross", p) >= RATES.crossing else "swap" if sx == sy else "guided" if u(f"{purpose}:mating:across", p) < RATES.guided else "copy"
        for turn, (b, d) in enumerate(((x, y), (y, x))):
            child = []
            for s, k in enumerate(BUDGETS):
                base, own, far = by_id[b][s], by_id[d][s], by_id[d][1 - s]
                genes = list(base)
                if mode == "swap" and base and own:
                    cut = 1 + int(u(f"{purpose}:cut:{s}", p) * max(len(by_id[x][s]) - 1, 1))
                    genes = base[:cut] + own[cut : cut + k]
                if mode == "guided":
                    most = [max(1, int(q * RATES.share)) for q in BUDGETS]
                    best = lambda genes, s, k: sorted(genes, key=lambda g: -w[s][g])[:k]
                    offered = best(own, s, most[s]) + [to[1 - s].get(g) for g in best(far, 1 - s, most[1 - s])]
                    new = []
                    for g in offered:
                        if g is not None and g < N and g not in base and g not in new:
                            new.append(g)
                    n = min(len(new), len(base))
                    weak = sorted(base, key=lambda g: w[s][g])[:n]
                    genes = [g for g in dict.fromkeys(base) if g not in weak] + new[:n]
                genes = list(dict.fromkeys(genes))[:k]
                for v in sorted(spare[s], key=lambda v: (u(f"{purpose}:fill", p * 2 + turn + first_id, s, v), v)):
                    if len(genes) < k and v not in genes:
                        genes.append(v)
                child.append(genes)
            out.append((p * 2 + turn + first_id, *child, mode))
    return out


def test_parents(spark, world):
    _, pop, rows, *_ = world
    got = [tuple(r) for r in generations.parents(pop, 40, 0.5, "t").orderBy("pair_id").collect()]
    assert got == plain_parents(rows, 40, 0.5, "t")
    kinds = {sx == sy for _, _, sx, _, sy in got}
    assert kinds == {True, False}
    one = pop.filter("skill = 2 AND id = 4")
    assert {tuple(r)[1:] for r in generations.parents(one, 3, 1.0, "t").collect()} == {(4, 2, 4, 2)}
    assert generations.parents(pop.limit(0), 3, 0.5, "t").count() == 0


def test_children(spark, world):
    guide, pop, rows, w, to, _ = world
    plain = plain_parents(rows, 30, 0.5, "t")
    pairs = spark.createDataFrame(plain, "pair_id bigint, x bigint, skill_x int, y bigint, skill_y int")
    got = sorted(tuple(r) for r in generations.children(pop, pairs, guide, BUDGETS, RATES, "c", 100).collect())
    want = sorted(plain_children(rows, plain, w, to, "c", 100))
    assert got == want
    assert {r[3] for r in got} == {"copy", "swap", "guided"}
    assert all(len(set(r[1])) == 4 and len(set(r[2])) == 3 for r in got)


def test_mutation(spark, world):
    guide, _, _, w, _, near = world
    rng = random.Random(9)
    rows = [(i, rng.sample(range(N), 4), rng.sample(range(N), 3), "copy") for i in range(25)] + [(25, [], [2, 21, 3], "copy")]
    got = sorted(tuple(r) for r in generations.mutated(spark.createDataFrame(rows, "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>, mode string"), guide, RATES, "m").collect())
    slots = {(r["node"], r["slot"]): r for r in guide.tables.arc_rows.collect()}
    want, kinds = [], set()
    for i, one, two, mode in rows:
        out = []
        for s, genes in enumerate((one, two)):
            now = list(genes)
            for pos, g in enumerate(genes):
                x = u("m:rate", i, s, pos)
                if x < RATES.random:
                    options = []
                    for t in range(RATES.tries):
                        at = u("m:slot", i, s, pos, t) * N
                        row = slots[(s, int(at))]
                        options.append(row["mine"] if at - int(at) < row["keep"] else row["other"])
                elif x < RATES.random + RATES.near:
                    options = sorted(near[s].get(g, []), key=lambda v: (-w[s][v], v))
                else:
                    continue
                fresh = [v for v in options if v not in now]
                if fresh:
                    now[pos] = fresh[0]
                kinds.add((x < RATES.random, bool(fresh)))
            out.append(now)
        want.append((i, *out, mode))
    assert got == want and len(kinds) == 4


def test_scores(spark):
    rng = random.Random(2)
    layers = [sorted({tuple(sorted(rng.sample(range(N), 2))) for _ in range(m)}) for m in (60, 40)]
    arcs = [graph.symmetric(spark.createDataFrame(e, "u bigint, v bigint")) for e in layers]
    rows = [(i, rng.sample(range(N), 4), rng.sample(range(N), 3)) for i in range(12)] + [(12, [], [1, 2]), (13, [], []), (14, [0, 1, 2, 3], [2, 3, 4])]
    got = {r["id"]: (r["t1"], r["t2"], r["t3"]) for r in generations.scores(spark.createDataFrame(rows, "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>"), *arcs, p=0.2).collect()}
    csr = [kernel.Csr(N, *(np.array([x for e in edges for x in (e[i], e[1 - i])]) for i in (0, 1))) for edges in layers]
    full = lambda g, a, b: kernel._side(g, a, set(b), np.ones(N, bool), np.diff(g.at).astype(np.int64), np.ones(N), 0.2)
    for i, a, b in rows:
        t1, t2 = full(csr[0], a, b), full(csr[1], b, a)
        joint = float((1 - (1 - kernel.activation(csr[0], a, 0.2)) * (1 - kernel.activation(csr[1], b, 0.2))).sum()) if a or b else 0.0
        share = joint / (kernel.two_hop(csr[0], a, 0.2) + kernel.two_hop(csr[1], b, 0.2) + 1e-12)
        assert got[i] == pytest.approx((t1, t2, share * 2 * t1 * t2 / (t1 + t2 + 1e-12)), abs=1e-8)


def test_start(spark, world):
    guide, _, _, w, *_ = world
    pairs = spark.createDataFrame([(1, 2), (3, 4), (50, 1), (5, 2)], "a bigint, b bigint")
    rows = generations.start(guide, 300, BUDGETS, pairs, 100, "s").collect()
    assert len(rows) == 300 and all(len(set(r["seeds_l1"])) == 4 and len(set(r["seeds_l2"])) == 3 for r in rows)
    assert all(set(r["seeds_l1"][:2]) <= {1, 3, 5} and 50 not in r["seeds_l1"] for r in rows if r["id"] >= 200)
    first = [r["seeds_l1"][0] for r in rows if r["id"] < 200]
    heavy = [v for v in w[0] if w[0][v] == 3.5]
    share = sum(w[0][v] for v in heavy) / sum(w[0].values())
    assert abs(sum(v in heavy for v in first) / 200 - share) < 4 * math.sqrt(share * (1 - share) / 200)


def test_search(spark, world):
    guide = world[0]
    rng = random.Random(3)
    arcs = [graph.symmetric(spark.createDataFrame(sorted({tuple(sorted(rng.sample(range(N), 2))) for _ in range(50)}), "u bigint, v bigint")) for _ in range(2)]
    asked = []

    def evaluate(pop):
        asked.append(pop.count())
        return generations.scores(pop, *arcs, p=0.1)

    history, pop = generations.search(guide, evaluate, generations.start(guide, 7, BUDGETS), 7, BUDGETS, 2, RATES)
    rows = [r.asDict() for r in history.orderBy("gen").collect()]
    assert [r["gen"] for r in rows] == [0, 1, 2] and asked == [7, 7, 7]
    for a, b in zip(rows, rows[1:]):
        assert all(a[f"best_{t}"] <= b[f"best_{t}"] for t in ("t1", "t2", "t3"))
        assert b["copy"] + b["swap"] + b["guided"] == 7
    left = pop.collect()
    assert len({r["id"] for r in left}) == 7 and max(r["t1"] for r in left) <= rows[-1]["best_t1"]
