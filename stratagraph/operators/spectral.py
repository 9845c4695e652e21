"""Spectral positions of a layer's nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uniform
from ..session import ship, stored
from .components import components
from .influence import MAX_ARCS

#: Rows of a batch that the task gives back.
BATCH = 10_000


def _of_components(nodes: DataFrame, rows: DataFrame, sizes: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, position) from ``rows(node, component, deg)``: k orthonormal vectors of eigenvalue 0, orthogonal to the trivial one.

    They are constant over the root of the degree in each of more than k components
    (``sizes(component, vol)``); the constants are drawn and made orthogonal by the
    (k + 1)-square matrix of their products, which alone comes to the driver.
    """

    def normal(j: int):
        u, v = (uniform(f"positions:{c}", F.lit(seed), F.col("component"), F.lit(j)) for c in "uv")
        return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * np.pi * v)

    total = sizes.agg(F.sum("vol")).collect()[0][0]
    drawn = stored(sizes.select("component", "vol", F.sqrt(F.col("vol") / F.lit(total)).alias("z0"), *[normal(j).alias(f"z{j}") for j in range(1, k + 1)]))
    for _ in range(2):  # the second time takes off what rounding left
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        sums = drawn.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in pairs]).collect()[0]
        gram = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"]
        turn = np.linalg.inv(np.linalg.cholesky(gram).T)
        drawn = drawn.select("component", "vol", *[sum((F.col(f"z{i}") * float(turn[i, j]) for i in range(1, j + 1)), F.col("z0") * float(turn[0, j])).alias(f"z{j}") for j in range(k + 1)])
    share = F.sqrt(F.col("deg") / F.col("vol"))
    found = rows.join(drawn, "component").select("node", F.array(*[F.col(f"z{j}") * share for j in range(1, k + 1)]).alias("position"))
    return nodes.select(F.col("node").cast("bigint").alias("node")).join(found, "node", "left").select("node", F.coalesce("position", F.array(*[F.lit(0.0)] * k)).alias("position"))


def positions(nodes: DataFrame, arcs: DataFrame, k: int = 4, rounds: int = 300, seed: int = 11) -> DataFrame:
    """(node, position): k smoothest non-trivial eigenvectors of the normalised Laplacian.

    Signs and rotations within equal eigenvalues are arbitrary; columns are
    orthonormal; isolated nodes and missing columns are 0.  Each component gives an
    eigenvalue 0, so that of more than k components the vectors are known exactly and
    the layer stays a table.  Of fewer they come from subspace iteration in one task,
    and the layer's number of arcs is checked before it is sent.
    """
    arcs = stored(arcs)
    part = components(arcs.toDF("a", "b")).withColumnRenamed("id", "node")
    own = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg")).join(part, "node", "left")
    own = stored(own.select("node", F.coalesce("component", "node").alias("component"), "deg"))
    sizes = stored(own.groupBy("component").agg(F.sum("deg").alias("vol")))
    if k > 0 and sizes.count() > k:
        return _of_components(nodes, own, sizes, k, seed)
    m = arcs.count()
    if m > MAX_ARCS:
        raise ValueError(f"{m} arcs; spectral positions take a layer of up to {MAX_ARCS}")
    spark = nodes.sparkSession
    ship(spark)
    # nodes and arcs go to the task as rows of one table, not through the driver; a node is an arc without an end
    rows = nodes.select(F.col("node").cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("dst")).unionByName(arcs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
        end = t.column("dst").is_valid()
        ids = np.sort(t.filter(pc.invert(end)).column("src").to_numpy())
        pairs = t.filter(end).sort_by([("src", "ascending"), ("dst", "ascending")])
        src, dst = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("src", "dst"))
        del t, pairs
        if len(ids):
            n = len(ids)
            deg = np.bincount(src, minlength=n).astype(float)
            live = deg > 0
            scale = np.where(live, 1 / np.sqrt(np.maximum(deg, 1)), 0.0)
            weight = scale[src] * scale[dst]
            width = min(k + 1, int(live.sum()))
            x = np.random.default_rng(seed).standard_normal((n, width)) * live[:, None]
            if width:
                x[:, 0] = np.sqrt(deg)
                for _ in range(rounds):
                    x = 0.5 * (x + np.stack([np.bincount(src, weight * x[dst, j], n) for j in range(width)], axis=1))
                    x, _ = np.linalg.qr(x)
                ax = np.stack([np.bincount(src, weight * x[dst, j], n) for j in range(width)], axis=1)
                value, turn = np.linalg.eigh(x.T @ ax)
                x = (x @ turn)[:, np.argsort(-value)][:, 1:] * live[:, None]
            out = np.zeros((n, k))
            out[:, : max(0, width - 1)] = x[:, :k] if width else 0
            for lo in range(0, n, BATCH):
                yield pa.RecordBatch.from_pydict({"node": ids[lo : lo + BATCH], "position": list(out[lo : lo + BATCH])}, schema=pa.schema([("node", pa.int64()), ("position", pa.list_(pa.float64()))]))

    return rows.repartition(1).mapInArrow(run, "node bigint, position array<double>")
