"""Closeness searches leave leaves out and read open nodes only; values against plain searches."""

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.operators import centrality


def plain(adj):
    out = {}
    for s in adj:
        dist, front = {s: 0}, [s]
        for a in front:
            for b in adj[a] - dist.keys():
                dist[b] = dist[a] + 1
                front.append(b)
        far = [d for d in dist.values() if d]
        out[s] = [len(far), sum(far), sum(1 / d for d in far)]
    return out


def network(n, m, seed):
    pairs = np.random.default_rng(seed).integers(0, n, (m, 2)).tolist()
    pairs += [(n, n + 1), *[(n + 2, n + 3 + i) for i in range(9)]]  # two leaves together, a star
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return adj


@pytest.mark.parametrize("shares, rows, slots", [(1, 8, 32), (3, 2048, 2), (2, 16, 1)])
def test_leaves_are_not_searched(monkeypatch, shares, rows, slots):
    for name, value in (("ROWS", rows), ("SLOTS", slots), ("STRETCH", 8), ("WIDTH", 64)):
        monkeypatch.setattr(centrality, name, value, raising=False)
    seen, keep = [], centrality._spread
    monkeypatch.setattr(centrality, "_spread", lambda *a: seen.append(a[2]) or keep(*a))
    adj = network(300, 380, 4)
    arcs = [(a, b) for a in adj for b in adj[a]]
    table = pa.table({"src": [a for a, _ in arcs], "dst": [b for _, b in arcs], "shares": [shares] * len(arcs)})
    got = {}
    for share in range(shares):
        for r in centrality._searched((pa.scalar(1), pa.scalar(share)), table).to_pylist():
            sums = got.setdefault(r["node"], [0, 0, 0])
            got[r["node"]] = [sums[0] + r["reached"], sums[1] + r["total"], sums[2] + r["inverse"]]
    want = plain(adj)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i])
    inner = [i for i in adj if len(adj[i]) > 1 or all(len(adj[b]) == 1 and b > i for b in adj[i])]
    assert set(seen) == {len(inner)} and len(inner) < len(adj)
