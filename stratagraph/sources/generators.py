"""Synthetic layers from hashed draws; each has exactly the asked number of edges where enough pairs exist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uniform
from ..operators.sampling import drawn_pairs
from ..session import ship

KINDS = ("er", "small_world", "scale_free", "hybrid", "community")


def random_edges(spark: SparkSession, n: int, m: int, purpose: str = "er") -> DataFrame:
    """m distinct edges, all pairs where there are fewer: the first of a sequence of hashed draws, which goes on until there are enough."""
    return drawn_pairs(spark, n, m, purpose)


def grown(spark: SparkSession, kind: str, n: int, m: int, graphs: int = 1, seed: int = 42) -> DataFrame:
    """(graph, u, v) of the kinds that grow edge by edge; one task a graph."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    ship(spark)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        g = int(part["graph"].iloc[0])
        edges = sorted(_edges(kind, n, m, np.random.default_rng([seed, g])))
        return pd.DataFrame({"graph": g, "u": [e[0] for e in edges], "v": [e[1] for e in edges]}, columns=["graph", "u", "v"]).astype("int64")

    return spark.range(graphs).withColumnRenamed("id", "graph").groupBy("graph").applyInPandas(one, "graph bigint, u bigint, v bigint")


def _edges(kind: str, n: int, m: int, rng: np.random.Generator) -> set[tuple[int, int]]:
    m = min(m, n * (n - 1) // 2)
    edges: set[tuple[int, int]] = set()

    def add(u: int, v: int) -> None:
        if u != v and len(edges) < m:
            edges.add((min(u, v), max(u, v)))

    pick = lambda: int(rng.integers(n))
    if kind in ("small_world", "hybrid"):
        rate = rng.uniform(0.2, 0.35) if kind == "small_world" else rng.uniform(0.4, 0.7)
        for d in range(1, max(1, m // n) + 1):
            for u in range(n):
                add(u, pick() if rng.random() < rate else (u + d) % n)
    if kind == "hybrid":
        for h in rng.choice(n, max(1, int(n * rng.uniform(0.02, 0.05))), replace=False):
            for _ in range(max(1, m // (10 * n))):
                add(int(h), pick())
    if kind == "scale_free":
        core = min(n, max(4, 2 * max(1, m // n)))
        for u in range(core):
            for v in range(u):
                add(u, v)
        ends = [x for e in edges for x in e]
        for u in range(core, n):
            for _ in range(max(1, m // n)):
                v = ends[int(rng.integers(len(ends)))]
                add(u, v)
                ends += [u, v]
    if kind == "community":
        home = rng.integers(int(rng.integers(2, 5)), size=n)
        groups = [np.flatnonzero(home == c) for c in np.unique(home)]
        for _ in range(20 * m):
            if len(edges) >= m:
                break
            u = pick()
            v = int(rng.choice(groups[int(np.searchsorted(np.unique(home), home[u]))])) if rng.random() < 0.7 else pick()
            add(u, v)
    while len(edges) < m:
        add(pick(), pick())
    return edges


def layer_nodes(spark: SparkSession, n: int, layers: int, cover: float, purpose: str = "cover") -> DataFrame:
    """(layer, node): each layer samples its share of nodes, and nodes that no layer took go to one hashed layer."""
    all_nodes = spark.range(n).withColumnRenamed("id", "node")
    taken = all_nodes.select(F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"), "node").filter(uniform(purpose, F.col("layer"), F.col("node")) < cover)
    left = all_nodes.join(taken.select("node"), "node", "left_anti").select(F.floor(uniform(f"{purpose}:rest", F.col("node")) * layers).cast("int").alias("layer"), "node")
    return taken.unionByName(left)
