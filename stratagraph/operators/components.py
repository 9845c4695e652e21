"""Connected components of a links table, all on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored

#: Links that one group hangs together on average.
LINKS = 1 << 18


def _together(table: pa.Table) -> pa.Table:
    """(a, b): each id that the links (a, b) of a group join to a smaller one, and the smallest that it reaches there."""
    kind = table.schema.field("a").type
    ids, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    x, y = at.reshape(2, -1)
    top = np.arange(len(ids))
    while True:
        # the smaller of two tops takes the larger one; then all point to the end of their chain
        p, q = top[x], top[y]
        if (p == q).all():
            break
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (top[top] != top).any():
            top = top[top]
    moved = np.flatnonzero(top != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[moved], kind), "b": pa.array(ids[top[moved]], kind)})


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``links(a, b)`` reaches.

    Links are dealt to groups of ``LINKS`` and hung together inside each; where
    one group holds all, that is the answer. Otherwise two star operations
    alternate until nothing changes: every larger neighbour is hung on the smallest one around (large star), then every
    smaller neighbour on the smallest (small star).  Rounds grow with the
    logarithm of the longest chain.  Minima are combined before each shuffle,
    and the joins back to the edges are plain equi-joins, whose large keys
    adaptive execution splits.  Each round is written to the shared folder.
    Nulls and self links are left out.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ship(edges.sparkSession)
    groups = max(1, -(-edges.count() // LINKS))
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(groups)))
    edges = stored(dealt.groupBy("part").applyInArrow(lambda t: _together(t.select(["a", "b"])), edges.schema).distinct())
    mark = _mark(edges) if groups > 1 else (0,)
    while mark[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.union(least.select("a", F.col("m").alias("b"))).distinct())
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number and an order-free digest of the edges: two equal marks mean that a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
    return r["n"], r["s"]
