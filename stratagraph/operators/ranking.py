"""Ranks, normalisations and evaluation metrics.

Global ranks come from ``running``: ranges of the order are ranked apart and
moved by what lies before them.  Where only a summary is wanted (``auc``), rows
are first reduced to one per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds running sums of the values, each row's own included, over a total order of the rows.

    Rows are dealt to tasks by ranges of the order and written once, so that
    both passes see the same ranges; one row a range is broadcast.
    """
    dealt = df.withColumns({f"_of_{k}": v for k, v in values.items()}).repartitionByRange(*order)
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_of_{k}").alias(f"_in_{k}") for k in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(f"_in_{k}").over(earlier), F.lit(0)).alias(f"_to_{k}") for k in values])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.sum(f"_of_{k}").over(inside) + F.col(f"_to_{k}")).alias(k) for k in values]
    return dealt.join(F.broadcast(before), "_range").select(*[c for c in df.columns if c not in values], *sums)


def ordinal(df: DataFrame, value: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """Ranks 1..n without ties: better values first, smaller ids among equals."""
    order = F.desc(value) if descending else F.asc(value)
    return running(df, [order, F.asc("id")], **{name: F.lit(1).cast("bigint")})


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """1-based ranks, equal values share the mean of theirs."""
    sizes = running(df.groupBy(value).agg(F.count("*").alias("_n")), [F.asc(value)], _upto=F.col("_n"))
    ranks = sizes.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, value)


def auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(auc): chance that a positive scores above a negative, ties half; null with one class only."""
    by = df.groupBy(score).agg(F.sum(F.col(y).cast("double")).alias("p"), F.sum(1.0 - F.col(y)).alias("q"))
    rows = running(by, [F.asc(score)], _upto=F.col("q")).select("p", "q", (F.col("_upto") - F.col("q")).alias("below"))
    return rows.agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(ap): mean precision at the positives, best scores first, smaller ids among equals."""
    run = running(df.select("id", score, y), [F.desc(score), F.asc("id")], hits=F.col(y), pos=F.lit(1))
    return run.agg((F.sum(F.when(F.col(y) == 1, F.col("hits") / F.col("pos")).otherwise(0.0)) / F.nullif(F.sum(y), F.lit(0))).alias("ap"))


def precision_at(df: DataFrame, k: int, score: str = "score", y: str = "y") -> DataFrame:
    return df.orderBy(F.desc(score), "id").limit(k).agg(F.avg(F.col(y).cast("double")).alias("precision"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho): correlation of average ranks; null where one side is constant."""
    ranked = average_ranks(average_ranks(df, x, "_rx"), y, "_ry")
    sd = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    return ranked.agg((F.covar_pop("_rx", "_ry") / F.nullif(sd, F.lit(0.0))).alias("rho"))


def minmax(df: DataFrame, x: str = "x") -> DataFrame:
    """x scaled to 0..1; null where all are equal."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.crossJoin(ends).withColumn("y", (F.col(x) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def zscore(df: DataFrame, x: str = "x", eps: float = 1e-8) -> DataFrame:
    m = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.crossJoin(m).withColumn("y", F.when(F.col("_s") == 0, 0.0).otherwise((F.col(x) - F.col("_m")) / (F.col("_s") + eps))).drop("_m", "_s")


def robust_score(df: DataFrame, x: str = "x", eps: float = 1e-8) -> DataFrame:
    """(x - median) / (median absolute deviation + eps); z-scores where that deviation is 0."""
    med = df.agg(F.percentile(x, 0.5).alias("_med"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    rows = df.crossJoin(med)
    mad = rows.agg(F.percentile(F.abs(F.col(x) - F.col("_med")), 0.5).alias("_mad"))
    plain = F.when(F.col("_s") == 0, 0.0).otherwise((F.col(x) - F.col("_m")) / (F.col("_s") + eps))
    return rows.crossJoin(mad).withColumn("y", F.when(F.col("_mad") == 0, plain).otherwise((F.col(x) - F.col("_med")) / (F.col("_mad") + eps))).drop("_med", "_m", "_s", "_mad")


def quantile_scores(df: DataFrame, x: str = "x", power: float = 0.1) -> DataFrame:
    """rank ** -power, best value first, scaled to 0..1."""
    ranked = ordinal(df, x, "_r").withColumn("_q", F.pow("_r", F.lit(-power)))
    return minmax(ranked, "_q").drop("_r", "_q")


def normalised(df: DataFrame, method: str, x: str = "x") -> DataFrame:
    """``minmax``, ``standard`` or ``quantile``; any other name is an error."""
    if method not in ("minmax", "standard", "quantile"):
        raise ValueError(f"unknown normalisation {method!r}")
    return {"minmax": minmax, "standard": robust_score, "quantile": quantile_scores}[method](df, x)


def finite_summary(df: DataFrame, x: str = "x") -> DataFrame:
    """(mean, std, n): mean and population deviation of the values that are finite numbers; null without any."""
    good = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))
    return df.agg(F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), F.count(good).alias("n"))


def statistics(df: DataFrame, x: str = "x", by: tuple[str, ...] = ()) -> DataFrame:
    """(mean, std, min, max, median, zero_ratio) to five places, over all rows or for each value of ``by``."""
    stats = {"mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x), "median": F.percentile(x, 0.5), "zero_ratio": F.avg((F.col(x) == 0).cast("double"))}
    return df.groupBy(*by).agg(*[F.round(v, 5).alias(k) for k, v in stats.items()])


def equal_bins(df: DataFrame, value: str, k: int) -> DataFrame:
    """Bins of equal numbers by descending value; the last one takes the remainder."""
    n = df.agg(F.count("*").alias("_n"))
    size = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return ordinal(df, value, "_r").crossJoin(n).withColumn("bin", F.least(F.floor((F.col("_r") - 1) / size), F.lit(k - 1)).cast("bigint")).drop("_r", "_n")


def skill_factors(df: DataFrame, tasks: list[str]) -> DataFrame:
    """Rank on every task, the first task of the best rank, and 1 / that rank."""
    out = df
    for t in tasks:
        out = ordinal(out, t, f"rank_{t}")
    best = F.least(*[F.col(f"rank_{t}") for t in tasks])
    which: Column = F.lit(None)
    for i, t in reversed(list(enumerate(tasks, 1))):
        which = F.when(F.col(f"rank_{t}") == best, i).otherwise(which)
    return out.withColumn("skill", which.cast("int")).withColumn("fitness", 1.0 / best)


def survival(df: DataFrame, n: int, elite: int = 1, tasks: int = 3) -> DataFrame:
    """Who stays: the elite of each skill by its own score, then each skill up to its share, then the fittest."""
    by_cost = Window.partitionBy("skill").orderBy(F.desc("cost"), "id")
    by_fit = Window.partitionBy("skill").orderBy(F.col("is_elite").desc(), F.desc("fitness"), "id")
    share = max(1, n // (2 * tasks))
    rows = df.withColumn("is_elite", (F.row_number().over(by_cost) <= elite).cast("int"))
    rows = rows.withColumn("tier", F.when(F.col("is_elite") == 1, 0).when(F.row_number().over(by_fit) <= share, 1).otherwise(2))
    order = ["tier", F.desc("fitness"), "id"]
    return rows.orderBy(*order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint")).drop("is_elite")
