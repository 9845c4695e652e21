"""Whole attacks on one layer in numpy: the sequential part of robustness, run by tasks over candidates."""

from __future__ import annotations

import numpy as np


class Csr:
    """A layer's adjacency in compressed rows; node ids 0..n-1. Sent to tasks whole, so its size is checked by the caller."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        order = np.lexsort((dst, src))
        self.n = n
        self.dst = dst[order].astype(np.int64)
        self.at = np.searchsorted(src[order], np.arange(n + 1))

    def around(self, v: int) -> np.ndarray:
        return self.dst[self.at[v] : self.at[v + 1]]


def _side(g: Csr, own: list[int], other: set[int], alive: np.ndarray, deg: np.ndarray, w: np.ndarray, p: float) -> float:
    mine = set(own)
    total = 0.0
    for s in own:
        total += w[s]
        if not alive[s]:
            continue
        for j in g.around(s):
            if not alive[j] or j in other:
                continue
            near = g.around(j)
            near = near[alive[near]]
            free = [k for k in near.tolist() if k not in other]
            total += p * (w[j] + p * w[free].sum())
            if j in mine:
                m = len(near) - len(free)
                total -= p * w[j] * (1.0 + p * (deg[j] >> min(m, 62)))
    return total


def robust(g: Csr, a: list[int], b: list[int], p: float, steps: int, wa: np.ndarray | None = None, wb: np.ndarray | None = None, bound: tuple[float, float] | None = None) -> tuple[float, float]:
    """Mean influence of either side over ``steps`` two-hop attacks.

    The attacker's scores are kept up to date: a removed node leaves its
    neighbours' degrees and the scores of what counted them.  With a ``bound``
    (score, -node) of nodes that ``g`` leaves out, not a number where one of them
    might have gone first.
    """
    ones = np.ones(g.n)
    wa = ones if wa is None else wa / wa.mean()
    wb = ones if wb is None else wb / wb.mean()
    set_a, set_b = set(a), set(b)
    tag = np.zeros(g.n, np.int64)
    tag[list(set_a)] |= 1
    tag[list(set_b)] |= 2
    block = np.where(tag & 1, 2, np.where(tag == 2, 1, 3))
    alive = np.ones(g.n, bool)
    deg = np.diff(g.at).astype(np.int64)
    src = np.repeat(np.arange(g.n), deg)
    counts = (tag[g.dst] & block[src]) == 0
    score = np.bincount(src[counts], 1.0 + deg[g.dst[counts]], g.n)
    sum_a = sum_b = 0.0
    for _ in range(steps):
        v = int(score.argmax())
        if bound is not None and (score[v], -v) <= bound:
            return float("nan"), float("nan")
        if alive[v]:
            near = g.around(v)
            near = near[alive[near]]
            sees = (tag[v] & block[near]) == 0
            score[near[sees]] -= 1.0 + deg[v]
            for u in near.tolist():
                deg[u] -= 1
                back = g.around(u)
                back = back[alive[back] & (back != v)]
                score[back[(tag[u] & block[back]) == 0]] -= 1.0
            alive[v], deg[v], score[v] = False, 0, 0.0
        sum_a += _side(g, a, set_b, alive, deg, wa, p)
        sum_b += _side(g, b, set_a, alive, deg, wb, p)
    return (sum_a / steps, sum_b / steps) if steps else (0.0, 0.0)


def two_hop(g: Csr, seeds: list[int], p: float) -> float:
    """Influence of one list without opponent or attack, unweighted."""
    deg = np.diff(g.at).astype(np.int64)
    return _side(g, seeds, set(), np.ones(g.n, bool), deg, np.ones(g.n), p)


def activation(g: Csr, seeds: list[int], p: float) -> np.ndarray:
    """Additive, capped probabilities over one and two arcs."""
    out = np.zeros(g.n)
    for s in seeds:
        for u in g.around(s).tolist():
            out[u] += p
            far = g.around(u)
            np.add.at(out, far[far != s], p * p)
    out = np.minimum(out, 1.0)
    out[seeds] = 1.0
    return out


def tasks(g1: Csr, g2: Csr, a: list[int], b: list[int], p: float, steps1: int, steps2: int, bounds: tuple = (None, None)) -> tuple[float, float, float]:
    """The three objectives of a candidate; the third reuses the first two."""
    t1, _ = robust(g1, a, b, p, steps1, bound=bounds[0])
    t2, _ = robust(g2, b, a, p, steps2, bound=bounds[1])
    joint = float((1 - (1 - activation(g1, a, p)) * (1 - activation(g2, b, p))).sum())
    share = joint / (two_hop(g1, a, p) + two_hop(g2, b, p) + 1e-12)
    return t1, t2, share * 2 * t1 * t2 / (t1 + t2 + 1e-12)
