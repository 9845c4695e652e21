"""Leading eigenvector of a layer by Lanczos steps: vectors are tables, the driver holds the small tridiagonal matrix alone."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


#: Nodes of a partition of the links, which are dealt once for all steps.
PART = 1 << 18


def leading(nodes: DataFrame, arcs: DataFrame, tolerance: float = 1e-7, most: int = 1_000) -> tuple[DataFrame, float, float]:
    """((node, x), eigenvalue, residual): the vector of length 1 of the largest eigenvalue of the arcs' symmetric matrix, its entries 0 or more.

    Steps go on until the residual |A x - value x| is at most ``tolerance`` times
    the eigenvalue; ``most`` steps without that are an error.  A new vector is made
    orthogonal to the two before it only: rounding may bring back copies of the
    leading pair, which leave it as it is.  Without arcs all entries are equal and
    the value is 0.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("x")), 0.0, 0.0
    # a node's link to itself carries its values on, so that a step is one join and one sum
    links = arcs.select("src", "dst", F.lit(False).alias("own")).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("own")))
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-n // PART))
    links = links.repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    state = nodes.select("node", F.lit(n**-0.5).alias("x"), F.lit(0.0).alias("u"))
    basis: list[DataFrame] = []
    alphas: list[float] = []
    betas: list[float] = []
    for _ in range(most):
        sent = links.join(state.withColumnRenamed("node", "src").repartition(parts, "src").hint("shuffle_hash"), "src")
        moved = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.when(F.col("own"), 0.0).otherwise(F.col("x"))).alias("a"), *[F.max(F.when(F.col("own"), F.col(c))).alias(c) for c in "xu"])
        moved = stored(moved.filter("x is not null"))
        basis.append(moved.select("node", "x"))
        alphas.append(float(moved.agg(F.sum(F.col("a") * F.col("x"))).collect()[0][0]))
        rest = F.col("a") - alphas[-1] * F.col("x") - (betas[-1] if betas else 0.0) * F.col("u")
        beta = float(moved.agg(F.sum(rest * rest)).collect()[0][0]) ** 0.5
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1))
        value, weights = float(values[-1]), vectors[:, -1]
        residual = abs(beta * float(weights[-1]))
        if residual <= tolerance * max(value, 1e-300) or beta <= 1e-12:
            break
        betas.append(beta)
        state = moved.select("node", (rest / beta).alias("x"), F.col("x").alias("u"))
    else:
        raise RuntimeError(f"residual {residual} after {most} steps")
    links.unpersist()
    each = [b.select("node", (F.col("x") * float(w)).alias("x")) for b, w in zip(basis, weights)]
    x = reduce(DataFrame.unionByName, each).groupBy("node").agg(F.abs(F.sum("x")).alias("x"))
    return x, value, residual
