"""Column functions: deterministic randomness, vectors and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 32 bits of its md5, so any engine can repeat it."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(_TWO_32)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def r6(c: Column) -> Column:
    """Rounded to six places, the precision of all reported numbers."""
    return F.round(c, 6) + F.lit(0.0)


def softmax(df: DataFrame, value: str, by: list[str], temperature: float = 1.0, log: bool = False, name: str = "share") -> DataFrame:
    """Adds each row's soft-max share of ``value`` among the rows of equal ``by`` (none: all rows), or its logarithm.

    The maximum is taken off first. Groups are summed before they meet their rows,
    so that one large group is no single task's work. Null values have no share;
    null keys make a group of their own.
    """
    x = F.col(value).cast("double") / temperature
    keys = [F.col(c).alias(f"_by_{c}") for c in by]
    top = df.groupBy(*keys).agg(F.max(x).alias("_top"))

    def met(rows: DataFrame, groups: DataFrame) -> DataFrame:
        if not by:
            return rows.crossJoin(F.broadcast(groups))  # one row
        same = [rows[c].eqNullSafe(groups[f"_by_{c}"]) for c in by]
        return rows.join(groups, same, "left").drop(*[f"_by_{c}" for c in by])

    shifted = met(df, top).withColumn("_x", x - F.col("_top")).drop("_top")
    sums = shifted.groupBy(*keys).agg(F.log(F.sum(F.exp("_x"))).alias("_lse"))
    out = met(shifted, sums)
    share = F.col("_x") - F.col("_lse")
    return out.withColumn(name, share if log else F.exp(share)).drop("_x", "_lse")
