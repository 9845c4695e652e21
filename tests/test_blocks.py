"""Block products against plain matrices: ties, zero vectors, repeated rows, crowded cells, several blocks."""

import numpy as np
import pytest

from stratagraph.operators import blocks, losses


def side(spark, rows):
    return spark.createDataFrame([(int(i), None if z is None else [float(v) for v in z]) for i, z in rows], "idx bigint, z array<double>").repartition(3)


def rows(seed, n, spread):
    """Tight groups, exact copies, zero, null and non-finite vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    out = [(i, centres[i % 6] + spread * rng.normal(size=8)) for i in range(n)]
    out += [(n + i, out[0][1]) for i in range(n // 2)]  # a third of all rows are copies of one
    return out + [(9000, np.zeros(8)), (9001, None), (9002, [np.nan] * 8)]


def units(given):
    x = np.array([np.zeros(8) if z is None or not np.isfinite(z).all() else z for _, z in given], float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.array([i for i, _ in given]), x / np.where(n > 0, n, 1)


def table(left, right, others=False):
    (ia, x), (ib, y) = units(left), units(right)
    s = np.round(x @ y.T, 9)
    return [(a, b, v) for a, r in zip(ia, s) for b, v in zip(ib, r) if not (others and a == b)]


@pytest.mark.parametrize("spread, others", [(0.02, False), (1.5, True)])
def test_best_of_each(spark, monkeypatch, spread, others):
    monkeypatch.setattr(blocks, "CELL", 10)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    left, right = (rows(1, 60, spread),) * 2 if others else (rows(1, 60, spread), rows(2, 80, spread))
    share = {}
    a = side(spark, left)
    b = a if others else side(spark, right)
    got = {}
    for r in blocks.best_of_each(a, b, 3, 9, others, share).collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"], pytest.approx(r["sim"], abs=1e-8)))
    want = {}
    for i, j, v in sorted(table(left, right, others), key=lambda t: (t[0], -t[2], t[1])):
        if len(want.setdefault(i, [])) < 3:
            want[i].append((len(want[i]) + 1, j, v))
    assert {k: sorted(v, key=lambda t: t[0]) for k, v in got.items()} == want
    assert share["pairs"] == len(left) * len(right)
    if spread < 1:
        assert share["products"] < 0.6 * share["pairs"]  # tight groups: far cells are left out, but for zero vectors


def test_best_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    left = rows(1, 30, 0.3)
    a = side(spark, left)
    for top in (1, 25, 10**6):
        got = [(r["a"], r["b"], pytest.approx(r["sim"], abs=1e-8)) for r in blocks.best_pairs(a, a, top, 9, others=True).collect()]
        want = sorted(table(left, left, True), key=lambda t: (-t[2], t[0], t[1]))[:top]
        assert got == want


def test_empty(spark):
    a = side(spark, rows(1, 5, 0.3))
    none = a.limit(0)
    assert blocks.best_of_each(a, none, 2).count() == 0 and blocks.best_of_each(none, a, 2).count() == 0
    assert blocks.best_pairs(a, none, 3).count() == 0


def test_losses_do_not_depend_on_blocks(spark, monkeypatch):
    a, b = side(spark, rows(1, 30, 0.5)[:45]), side(spark, rows(2, 30, 0.5)[:45])
    w = a.selectExpr("idx", "1.0D / (1 + idx) as w")

    def measured():
        role = losses.role_alignment(a, w, b, w).collect()[0]
        return [*role, losses.info_nce(a, b).collect()[0][0], losses.weighted_discrepancy(a, w, b, w).collect()[0][0]]

    one = measured()
    monkeypatch.setattr(blocks, "BLOCK", 7)
    assert np.allclose(one, measured()) and all(v > 0 for v in one)


def test_rows_that_visit_all_cells_travel_once_a_group(spark, monkeypatch):
    """Evenly spread vectors: no cell can be left out, and a row is still sent to a group of cells once."""
    monkeypatch.setattr(blocks, "CELL", 10)
    given = [(i, z) for i, z in enumerate(np.random.default_rng(5).normal(size=(200, 8)))]
    a = side(spark, given)
    sent = []
    monkeypatch.setattr(blocks, "stored", lambda df, keep=blocks.stored: sent.append(keep(df)) or sent[-1])
    got = sorted((r["a"], r["rank"], r["b"]) for r in blocks.best_of_each(a, a, 4, 9, True).collect())
    want = sorted(table(given, given, True), key=lambda t: (t[0], -t[2], t[1]))
    assert got == sorted((t[0], i % 199 + 1, t[1]) for i, t in enumerate(want) if i % 199 < 4)
    rows_sent = [f.count() for f in sent if "wanted" in f.columns or "cell" in f.columns and "angle" not in f.columns]
    assert rows_sent and max(rows_sent) <= 200
