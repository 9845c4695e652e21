"""How well embeddings predict edges of a layer and align two layers. Sides are (idx, z), weights (idx, w).

Scores are rounded to nine places before they are ranked, so that their order
doesn't depend on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cosine, dot
from . import blocks, ranking, sampling, similarity


def _scored(pairs: DataFrame, side: DataFrame, unit: bool) -> DataFrame:
    """(id, y, score) of labelled pairs (u, v, y) whose ends have a vector."""
    z = side.select("idx", F.col("z").cast("array<double>").alias("z"))
    rows = pairs.join(z.toDF("u", "zu"), "u").join(z.toDF("v", "zv"), "v")
    score = cosine(F.col("zu"), F.col("zv")) if unit else dot(F.col("zu"), F.col("zv"))
    return rows.select(F.concat_ws(":", "y", "u", "v").alias("id"), "y", F.round(F.coalesce(score, F.lit(0.0)), 9).alias("score"))


def _edges_of(edges: DataFrame, side: DataFrame) -> DataFrame:
    ids = side.select("idx")
    return edges.join(ids.toDF("u"), "u", "left_semi").join(ids.toDF("v"), "v", "left_semi").select("u", "v")


def _labelled(edges: DataFrame, others: DataFrame) -> DataFrame:
    return edges.select("u", "v", F.lit(1).alias("y")).unionByName(others.select("u", "v", F.lit(0).alias("y")))


def edge_prediction(edges: DataFrame, side: DataFrame, purpose: str = "negative") -> DataFrame:
    """(auc, ap) of inner products: edges between vectors against as many hashed pairs without an edge; ids are 0 to n - 1."""
    near = _edges_of(edges, side)
    far = sampling.drawn_pairs(side.sparkSession, side.count(), near.count(), purpose, near)
    rows = _scored(_labelled(near, far), side, False)
    return ranking.auc(rows).crossJoin(ranking.average_precision(rows))


def reconstruction(edges: DataFrame, side: DataFrame, most: int = 100, purpose: str = "rebuild") -> DataFrame:
    """(auc, precision) of cosines: edges against as many pairs without one (at most ten a node), and the edges' share of the best min(edges, ``most``)."""
    near = _edges_of(edges, side)
    m, n = near.count(), side.count()
    rows = _scored(_labelled(near, sampling.drawn_pairs(side.sparkSession, n, min(m, 10 * n), purpose, near)), side, True)
    return ranking.auc(rows).crossJoin(ranking.precision_at(rows, min(m, most)))


def reconstruction_all(edges: DataFrame, side: DataFrame, k: int = 50, purpose: str = "any") -> DataFrame:
    """(auc, precision): edges against three times as many hashed pairs of any kind (at most 10,000), and the edges' share of the k most similar of all ordered pairs."""
    from ..functions import uniform

    near = _edges_of(edges, side)
    m, n = near.count(), side.count()
    ends = [F.floor(uniform(f"{purpose}:{c}", F.col("id")) * n).cast("bigint").alias(c) for c in "uv"]
    rows = _scored(_labelled(near, side.sparkSession.range(min(3 * m, 10_000)).select("id", *ends)), side, True)
    best = blocks.best_pairs(side, side, max(1, min(k, m)), 9, others=True).limit(min(k, m))
    known = near.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("hit"))
    known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "hit"))
    return ranking.auc(rows).crossJoin(best.join(known, ["a", "b"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("precision")))


def _unit(side: DataFrame) -> DataFrame:
    z = side.select("idx", F.col("z").cast("array<double>").alias("z"))
    return z.select("idx", F.expr("transform(z, x -> x / nullif(sqrt(aggregate(z, 0.0D, (s, y) -> s + y * y)), 0.0D))").alias("z"))


def roles(a: DataFrame, wa: DataFrame, b: DataFrame, wb: DataFrame, ratio: float, least: int, most: int | None = None) -> DataFrame:
    """(hub_center_sim, hub_max_sim, periph_center_sim, separation, hub_separation): centroids of the heaviest and the lightest rows of either side.

    ``separation`` is the mean distance of a side's two centroids,
    ``hub_separation`` how much nearer the hubs' centroids are to one another
    than the first side's own two.
    """
    parts, hubs = None, []
    for name, side, w in (("a", a, wa), ("b", b, wb)):
        kept = _unit(side).join(sampling.ends(w, ratio, least, most), "idx")
        hubs.append(kept.filter("role = 'hub'").select("idx", "z"))
        one = kept.select(F.concat(F.lit(name), F.substring("role", 1, 1)).alias("part"), F.posexplode("z").alias("pos", "x"))
        parts = one if parts is None else parts.unionByName(one)
    at = parts.groupBy("pos").pivot("part", ["ah", "ap", "bh", "bp"]).agg(F.avg("x"))
    cos = lambda p, q: F.sum(F.col(p) * F.col(q)) / F.nullif(F.sqrt(F.sum(F.col(p) * F.col(p)) * F.sum(F.col(q) * F.col(q))), F.lit(0.0))
    row = at.agg(cos("ah", "bh").alias("hub_center_sim"), cos("ap", "bp").alias("periph_center_sim"), cos("ah", "ap").alias("own"), cos("bh", "bp").alias("its"))
    best = blocks.best_of_each(*hubs, 1).agg(F.avg("sim").alias("hub_max_sim"))
    return row.crossJoin(best).select("hub_center_sim", "hub_max_sim", "periph_center_sim", (1.0 - (F.col("own") + F.col("its")) / 2).alias("separation"), (F.col("hub_center_sim") - F.col("own")).alias("hub_separation"))


def rank_agreement(a: DataFrame, wa: DataFrame, b: DataFrame, wb: DataFrame) -> DataFrame:
    """(rank_correlation, alpha_rank_corr): do a's rows and their most similar rows of b weigh alike?

    First by the formula over squared differences of ordinal ranks, kept within
    -1 and 1; then as the correlation of average ranks, 0 where undefined.
    """
    match = similarity.translation(a, b, 9)
    rank = lambda w, c: ranking.ordinal(w.select(F.col("idx").alias("id"), "w"), "w", f"r{c}").withColumnRenamed("w", f"w{c}").withColumnRenamed("id", c)
    rows = match.join(rank(wa, "a"), "a").join(rank(wb, "b"), "b")
    n, d = F.count("*").cast("double"), (F.col("ra") - F.col("rb")).cast("double")
    plain = rows.agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - 6.0 * F.sum(d * d) / F.nullif(n * (n * n - 1.0), F.lit(0.0)))).alias("rank_correlation"))
    rho = ranking.spearman(rows.select("wa", "wb"), "wa", "wb")
    return plain.crossJoin(rho).select("rank_correlation", F.coalesce("rho", F.lit(0.0)).alias("alpha_rank_corr"))
