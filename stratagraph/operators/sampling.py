"""Hashed samples: pairs without an edge, two-arc pairs, weighted samples, hubs and peripheries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uniform
from ..session import stored
from .ranking import running


def drawn_pairs(spark: SparkSession, n: int, m: int, purpose: str, without: DataFrame | None = None) -> DataFrame:
    """(u, v) with u < v < n: the first m distinct pairs of a sequence of hashed draws, edges of ``without`` left out; all there are where m is more."""
    taken = None if without is None else without.filter(f"u >= 0 and v < {n}").select("u", "v").distinct()
    asked = min(m, n * (n - 1) // 2 - (0 if taken is None else taken.count()))
    draws = 4 * m + 16
    while True:
        x, y = (F.floor(uniform(f"{purpose}:{c}", F.col("id")) * n).cast("bigint").alias(c) for c in "xy")
        found = spark.range(draws).select("id", x, y).filter("x <> y").select("id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        found = found if taken is None else found.join(taken, ["u", "v"], "left_anti")
        found = stored(found.groupBy("u", "v").agg(F.min("id").alias("id")).orderBy("id").limit(m))
        if found.count() >= asked:
            return found.select("u", "v")
        draws *= 4


def two_arc_pairs(arcs: DataFrame, m: int, purpose: str) -> DataFrame:
    """(id, u, w): m draws of an arc (u, v) and then of a neighbour w of v; draws that come back to u are left out. The two may be neighbours."""
    spark = arcs.sparkSession
    ranked = stored(running(arcs.select("src", "dst"), [F.asc("src"), F.asc("dst")], at=F.lit(1)))
    size = ranked.count()
    first = ranked.groupBy(F.col("src").alias("v")).agg(F.min("at").alias("first"), F.count("*").alias("deg"))
    at = (F.floor(uniform(f"{purpose}:arc", F.col("id")) * size) + 1).alias("at")
    rows = spark.range(m).select("id", at).join(ranked, "at").select("id", F.col("src").alias("u"), F.col("dst").alias("v")).join(first, "v")
    at = (F.col("first") + F.floor(uniform(f"{purpose}:end", F.col("id")) * F.col("deg"))).alias("at")
    return rows.select("id", "u", at).join(ranked, "at").filter(F.col("u") != F.col("dst")).select("id", "u", F.col("dst").alias("w"))


def capped(weights: DataFrame, most: int, mode: str = "topk", purpose: str = "cap") -> DataFrame:
    """(idx, w): all rows where there are at most ``most``, else so many: the heaviest, or with ``weighted`` a draw by weight without replacement."""
    if mode not in ("topk", "weighted"):
        raise ValueError(f"unknown sample mode {mode!r}")
    key = F.col("w") if mode == "topk" else F.when(F.col("w") > 0, F.log(F.greatest(uniform(purpose, F.col("idx")), F.lit(1e-12))) / F.col("w"))
    if most <= 0:
        return weights.select("idx", "w")
    return weights.select("idx", "w", key.alias("_key")).orderBy(F.desc_nulls_last("_key"), "idx").limit(most).select("idx", "w")


def ends(weights: DataFrame, ratio: float, least: int, most: int | None = None) -> DataFrame:
    """(idx, role): the heaviest (``hub``) and the lightest (``periphery``) floor(n * ratio) rows, at least ``least`` and at most ``most``; smaller ids first among equals."""
    n = weights.count()
    k = max(least, int(n * ratio))
    k = min(n, k if most is None else min(most, k))
    hub = weights.orderBy(F.desc("w"), "idx").limit(k).select("idx", F.lit("hub").alias("role"))
    return hub.unionByName(weights.orderBy("w", "idx").limit(k).select("idx", F.lit("periphery").alias("role")))


def quantile_hubs(weights: DataFrame, q: float) -> DataFrame:
    """(idx): rows whose weight reaches the exact, linearly interpolated quantile."""
    at = weights.agg(F.percentile("w", q).alias("_at"))
    return weights.crossJoin(at).filter("w >= _at").select("idx")
