"""Walk powers against dense matrices."""

import numpy as np
import pytest

from stratagraph.operators import powers


def network(seed=3, n=60):
    """Ids far apart, a hub, an isolated part; both directions, and the dense step matrix."""
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((n, n)) < 0.06, 1)
    a[0, 1 : n - 4] = True
    a[:, n - 2 :] = False
    a = a | a.T
    ids = np.arange(n) * 1_000_003 - 7
    arcs = [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(a)]
    deg = a.sum(1, keepdims=True)
    return ids, arcs, np.divide(a, deg, out=np.zeros(a.shape), where=deg > 0)


USUAL, SMALL = (powers.ENTRIES, powers.PART, powers.PRODUCTS), (40, 3, 50)


@pytest.mark.parametrize("k, sizes", [(1, USUAL), (2, USUAL), (3, USUAL), (3, SMALL), (5, SMALL)])
def test_powers(spark, monkeypatch, k, sizes):
    entries, part, products = sizes
    for name, value in (("ENTRIES", entries), ("PART", part), ("PRODUCTS", products)):
        monkeypatch.setattr(powers, name, value)
    ids, arcs, p = network()
    dense = [np.linalg.matrix_power(p, i) for i in range(1, k + 1)]
    place = {int(x): i for i, x in enumerate(ids)}
    table = spark.createDataFrame(arcs, "src bigint, dst bigint")
    names = [f"p{i}" for i in range(1, k + 1)]
    if k <= 3:
        got = powers.all_pairs(table, k).collect()
        assert len(got) == int((sum(dense) > 0).sum())
        for r in got:
            assert [r[c] for c in names] == pytest.approx([d[place[r["src"]], place[r["dst"]]] for d in dense])
    asked = arcs[:200] + [(int(ids[i]), int(ids[-1 - i])) for i in range(10)] + [(int(ids[5]), int(ids[5])), arcs[0], (None, 3), (123, 124)]
    got = powers.of_pairs(spark.createDataFrame(asked, "src bigint, dst bigint"), table, k).collect()
    assert len(got) == len({a for a in asked if a[0] is not None})
    for r in got:
        want = [d[place[r["src"]], place[r["dst"]]] if r["src"] in place else 0.0 for d in dense]
        assert [r[c] for c in names] == pytest.approx(want)


def test_no_arcs(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert powers.all_pairs(none, 3).count() == 0
    got = powers.of_pairs(spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), none, 3).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.0, 0.0, 0.0)]
