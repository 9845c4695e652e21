"""Seed lists and node weights as they come in: range filters, splits, padding, and feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(seeds: Column, n: int | Column) -> Column:
    """Ids from 0 to n - 1 in their order, repeats kept; null becomes empty."""
    return F.coalesce(F.filter(seeds, lambda x: (x >= 0) & (x < n)), F.array().cast("array<bigint>"))


def split_pair(flat: Column, first: int, second: int) -> tuple[Column, Column]:
    """A flat list as two: the first so many, then so many of the rest; short lists give short parts."""
    return F.slice(flat, 1, first), F.slice(flat, first + 1, second)


def flat(one: Column, two: Column) -> Column:
    """Both seed lists one after the other; null counts as empty."""
    none = F.array().cast("array<bigint>")
    return F.concat(F.coalesce(one, none), F.coalesce(two, none))


def guarded(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, w): the nodes' weights; 1 for each where there are fewer weights than nodes."""
    sizes = nodes.agg(F.count("*").alias("n")).crossJoin(weights.agg(F.count("*").alias("m")))
    rows = nodes.join(weights.select("node", "w"), "node", "left").crossJoin(sizes)
    return rows.select("node", F.when(F.col("m") < F.col("n"), 1.0).otherwise(F.coalesce("w", F.lit(1.0))).alias("w"))


def normalised(nodes: DataFrame, weights: DataFrame, floor: float = 0.0) -> DataFrame:
    """(node, w): missing weights take the mean of the others, none is below ``floor``, all sum to 1; even shares without any weight."""
    facts = weights.agg(F.avg("w").alias("mean")).crossJoin(nodes.agg(F.count("*").alias("n")))
    rows = nodes.join(weights.select("node", "w"), "node", "left").crossJoin(facts)
    rows = rows.select("node", "n", F.greatest(F.coalesce("w", "mean", F.lit(0.0)), F.lit(floor)).alias("w"))
    total = rows.agg(F.sum("w").alias("all"))
    return rows.crossJoin(total).select("node", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(1.0 / F.col("n")).alias("w"))


def feature_rows(nodes: DataFrame, blocks: list[tuple[DataFrame, int]]) -> DataFrame:
    """(node, x): the blocks' arrays (node, x) of stated widths end to end; missing rows, nulls, NaN and infinities are 0."""
    rows = nodes.select("node")
    for i, (block, _) in enumerate(blocks):
        rows = rows.join(block.select("node", F.col("x").alias(f"x{i}")), "node", "left")
    clean = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    parts = [F.transform(F.coalesce(F.col(f"x{i}").cast("array<double>"), F.array_repeat(F.lit(0.0), width)), clean) for i, (_, width) in enumerate(blocks)]
    return rows.select("node", F.concat(*parts).alias("x"))
