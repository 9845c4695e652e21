"""Embeddings of two sides: cosine tables, top-k retrieval, alignment quality.

Sides are DataFrames (idx, z) of any size.  Retrieval goes through ``blocks``;
``pairs`` makes the whole table where all of it is wanted: ``crossed`` broadcasts
a right side whose size it has checked and deals a larger one by blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot
from ..session import stored
from . import blocks

#: Rows of the right side up to which it is broadcast.
MAX_RIGHT = 20_000
BLOCK = 4_096


def crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one side with every row of the other: a right side of up to MAX_RIGHT rows is broadcast, a larger one is joined by blocks."""
    n = right.count()
    if n <= MAX_RIGHT:
        return left.crossJoin(F.broadcast(right))
    parts = -(-n // BLOCK)
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(parts)))
    spread = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return spread.join(dealt.hint("shuffle_hash"), "_block").drop("_block")


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, sim): cosine of every pair; ``blocks`` keeps a few a row without forming all."""
    # vectors are scaled once, so each pair costs one inner product
    unit = lambda df, c, z: df.select(F.col("idx").alias(c), F.transform("z", lambda x: x.cast("double")).alias("_v")).select(c, F.expr("transform(_v, x -> x / nullif(sqrt(aggregate(_v, 0.0D, (s, y) -> s + y * y)), 0.0D))").alias(z))
    return crossed(unit(left, "a", "za"), unit(right, "b", "zb")).select("a", "b", F.coalesce(dot(F.col("za"), F.col("zb")), F.lit(0.0)).alias("sim"))


def top_k(sims: DataFrame, k: int, by: str = "a", of: str = "b") -> DataFrame:
    """The k most similar partners of each; smaller ids first among equals."""
    w = Window.partitionBy(by).orderBy(F.desc("sim"), of)
    return sims.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def translation(left: DataFrame, right: DataFrame, digits: int = 12) -> DataFrame:
    """(a, b): the most similar node of the other side, the smallest id among equals."""
    return blocks.best_of_each(left, right, 1, digits).select("a", "b")


def knn(side: DataFrame, k: int) -> DataFrame:
    """(a, b, sim, rank): cosine neighbours within one side, itself left out."""
    return blocks.best_of_each(side, side, k, others=True)


def mutual(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(mutual_rate, mean_top1, mean_topk): how often a's best partner has a among its k best."""
    forth = stored(blocks.best_of_each(left, right, k))
    back = blocks.best_of_each(right, left, k).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1.0).alias("hit"))
    first = forth.filter("rank = 1").join(back, ["a", "b"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("mutual_rate"), F.avg("sim").alias("mean_top1"))
    return first.crossJoin(forth.agg(F.avg("sim").alias("mean_topk")))


def recall(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(recall): share of ids that are among the k best of their own."""
    hit = blocks.best_of_each(left, right, k).groupBy("a").agg(F.max((F.col("a") == F.col("b")).cast("double")).alias("hit"))
    return hit.agg(F.avg("hit").alias("recall"))
