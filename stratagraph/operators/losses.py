"""Alignment losses as aggregates over embedding sides (idx, z) with weights (idx, w). Pairs stay inside ``blocks``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine, dot, uniform
from ..session import ship, stored
from . import blocks
from .ranking import equal_bins, ordinal

SIGMAS = (1.0, 2.0, 4.0, 8.0, 16.0)
#: Kernels of a strip of rows that stand in memory at once.
TILE = 1 << 18


def _kernel_sum(p: np.ndarray, u: np.ndarray, q: np.ndarray, v: np.ndarray) -> float:
    """u K v, where K is the mean over the widths of the kernel of every two rows; ``TILE`` kernels stand at once.

    Each width is twice the one before, so that its kernel to the fourth power is the one before's.
    """
    step = max(1, TILE // max(1, len(q)))
    size, total = (q * q).sum(1), 0.0
    for lo in range(0, len(p), step):
        some = p[lo : lo + step]
        k = some @ q.T
        k *= -2.0
        k += (some * some).sum(1)[:, None]
        k += size
        np.maximum(k, 0.0, out=k)
        k *= -1.0 / (2 * SIGMAS[-1] ** 2)
        np.exp(k, out=k)
        for width in range(len(SIGMAS)):
            if width:
                np.square(k, out=k)
                np.square(k, out=k)
            total += float(u[lo : lo + step] @ k @ v)
    return total / len(SIGMAS)


def _kernel_mean(a: DataFrame, wa: DataFrame, b: DataFrame, wb: DataFrame, name: str) -> DataFrame:
    """Weighted mean kernel over all pairs: one number a pair of blocks leaves its task."""

    def reduce(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.stack(f["z"].to_numpy()) for f in (x, y))
        return pd.DataFrame({"part": [_kernel_sum(p, x["w"].to_numpy(float), q, y["w"].to_numpy(float))]})

    side = lambda z, w: z.join(w, "idx").select("idx", F.col("z").cast("array<double>").alias("z"), F.col("w").cast("double").alias("w"))
    return blocks.by_blocks(side(a, wa), side(b, wb), reduce, "part double").agg(F.sum("part").alias(name))


def weighted_discrepancy(a: DataFrame, wa: DataFrame, b: DataFrame, wb: DataFrame) -> DataFrame:
    """(ammd): squared kernel distance of two weighted sets of vectors, over five widths."""
    rows = _kernel_mean(a, wa, a, wa, "aa").crossJoin(_kernel_mean(b, wb, b, wb, "bb")).crossJoin(_kernel_mean(a, wa, b, wb, "ab"))
    return rows.select((F.col("aa") + F.col("bb") - 2 * F.col("ab")).alias("ammd"))


def _graph_shares(side: DataFrame, most: int, mode: str, purpose: str) -> DataFrame:
    """(graph, idx, z, w): weights below 0 as 0, over their graph's sum (all equal where that is 0), then at most ``most`` rows a graph."""
    if mode not in ("topk", "weighted"):
        raise ValueError(f"unknown sample mode {mode!r}")
    w = F.greatest(F.coalesce(F.col("w").cast("double"), F.lit(0.0)), F.lit(0.0))
    side = side.select("graph", "idx", F.col("z").cast("array<double>").alias("z"), w.alias("w")).filter("graph is not null and z is not null")
    total = side.groupBy("graph").agg(F.sum("w").alias("_t"), F.count("*").alias("_n"))
    side = side.join(total, "graph").withColumn("w", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(1.0 / F.col("_n")))
    if most > 0:
        key = F.col("w") if mode == "topk" else F.when(F.col("w") > 0, F.log(F.greatest(uniform(purpose, F.col("graph"), F.col("idx")), F.lit(1e-12))) / F.col("w"))
        order = Window.partitionBy("graph").orderBy(F.desc_nulls_last(key), "idx")
        # at most so many rows a graph leave each partition before the shuffle
        side = side.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    return stored(side.select("graph", "idx", "z", "w"))


def _graph_kernels(a: DataFrame, b: DataFrame, sign: float) -> DataFrame:
    """(graph, part): ``sign`` times the weighted kernel sums of every graph. A large graph is many tasks, small ones share one."""
    n, m = (s.groupBy("graph").agg(F.ceil(F.count("*") / blocks.BLOCK).alias(c)) for s, c in ((a, "_n"), (b, "_m")))
    sizes = n.join(m, "graph")
    shelves = F.lit(int(-(-max(a.count(), b.count()) // blocks.BLOCK) or 1))
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    shelf = F.pmod(F.xxhash64("graph"), shelves).alias("shelf")
    left = a.join(sizes, "graph").withColumn("l", F.pmod(F.xxhash64("idx"), F.col("_n"))).withColumn("r", numbers("_m")).select(shelf, "l", "r", "graph", "z", "w")
    right = b.join(sizes, "graph").withColumn("r", F.pmod(F.xxhash64("idx"), F.col("_m"))).withColumn("l", numbers("_n")).select(shelf, "l", "r", "graph", "z", "w")
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])  # both sides may be one table

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y.columns = [c[1:] for c in y.columns]
        met, out = dict(list(y.groupby("graph"))), []
        for graph, rows in x.groupby("graph"):
            if graph in met:
                other = met[graph]
                k = _kernel_sum(np.stack(rows["z"].to_numpy()), rows["w"].to_numpy(), np.stack(other["z"].to_numpy()), other["w"].to_numpy())
                out.append((graph, sign * k))
        return pd.DataFrame(out, columns=["graph", "part"])

    kind = a.schema["graph"].dataType.simpleString()
    keys = ("shelf", "l", "r")
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInPandas(run, f"graph {kind}, part double")


def discrepancy_of_graphs(a: DataFrame, b: DataFrame, most: int = 0, mode: str = "topk") -> DataFrame:
    """(graph, ammd): the squared kernel distance of each graph's two sides, rows (graph, idx, z, w) of vectors of one length.

    Weights below 0 and null ones count as 0 and are divided by their graph's sum;
    a graph without any has equal ones. With ``most`` a side is cut to its heaviest
    rows (``topk``) or to a draw by weight (``weighted``), whose weights stay as
    they are. Graphs that lack a side are left out, as are null graphs and vectors.
    """
    ship(a.sparkSession)
    a, b = _graph_shares(a, most, mode, "graphs:a"), _graph_shares(b, most, mode, "graphs:b")
    both = a.select("graph").distinct().intersect(b.select("graph"))
    own = [s.join(both, "graph", "left_semi") for s in (a, b)]
    parts = [_graph_kernels(own[0], own[0], 1.0), _graph_kernels(own[1], own[1], 1.0), _graph_kernels(own[0], own[1], -2.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("graph").agg(F.sum("part").alias("ammd"))


def mean_discrepancy(a: DataFrame, b: DataFrame, most: int = 0, mode: str = "topk") -> DataFrame:
    """(ammd, graphs): mean over the graphs that have both sides, 0 without any."""
    rows = discrepancy_of_graphs(a, b, most, mode)
    return rows.agg(F.coalesce(F.avg("ammd"), F.lit(0.0)).alias("ammd"), F.count("*").alias("graphs"))


def info_nce(a: DataFrame, b: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(loss): symmetric contrastive loss; the positive of each id is its own on the other side.

    A block leaves its maximum and its sum of exponentials a row.
    """

    def reduce(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        logit = blocks.unit(x["z"]) @ blocks.unit(y["z"]).T / temperature
        out = []
        for by, m, f in (("a", logit, x), ("b", logit.T, y)):
            top = m.max(1)
            out.append(pd.DataFrame({"by": by, "idx": f["idx"], "top": top, "mass": np.exp(m - top[:, None]).sum(1)}))
        return pd.concat(out)

    parts = blocks.by_blocks(a.select("idx", "z"), b.select("idx", "z"), reduce, "by string, idx bigint, top double, mass double")
    top = F.max("top").over(Window.partitionBy("by", "idx"))
    rows = parts.withColumn("most", top).groupBy("by", "idx").agg((F.first("most") + F.log(F.sum(F.col("mass") * F.exp(F.col("top") - F.col("most"))))).alias("lse"))
    own = a.select("idx", F.col("z").alias("x")).join(b.select("idx", F.col("z").alias("y")), "idx")
    own = own.select("idx", (F.coalesce(cosine(F.col("x"), F.col("y")), F.lit(0.0)) / temperature).alias("pos"))
    means = rows.join(own, "idx").groupBy("by").agg(F.avg(F.col("lse") - F.col("pos")).alias("l"))
    return means.agg((F.sum("l") / 2).alias("loss"))


def reconstruction(pairs: DataFrame, side: DataFrame, scale: float = 5.0) -> DataFrame:
    """(loss): weighted cross-entropy of scaled cosines on labelled pairs (u, v, y).

    A pair weighs 1 / sqrt((d_u + 1)(d_v + 1)), degrees counted in the first
    column of its own class's list.
    """
    deg = pairs.groupBy("y", F.col("u").alias("node")).agg(F.count("*").alias("d"))
    z = side.select(F.col("idx").alias("node"), F.expr("transform(z, x -> double(x))").alias("z"))
    end = lambda c, d, zz: (deg.select("y", F.col("node").alias(c), F.col("d").alias(d)), z.select(F.col("node").alias(c), F.col("z").alias(zz)))
    rows = pairs
    for c in ("u", "v"):
        degrees, vectors = end(c, f"d{c}", f"z{c}")
        rows = rows.join(vectors, c).join(degrees, ["y", c], "left")
    logit = scale * dot(F.col("zu"), F.col("zv")) / F.nullif(F.sqrt(dot(F.col("zu"), F.col("zu")) * dot(F.col("zv"), F.col("zv"))), F.lit(0.0))
    rows = rows.select("y", logit.alias("x"), (1.0 / F.sqrt((F.coalesce("du", F.lit(0)) + 1.0) * (F.coalesce("dv", F.lit(0)) + 1.0))).alias("w"))
    bce = F.greatest("x", F.lit(0.0)) - F.col("x") * F.col("y") + F.log1p(F.exp(-F.abs("x")))
    per = rows.groupBy("y").agg(F.avg(F.col("w") * bce).alias("l"))
    return per.agg(F.sum("l").alias("loss"))


def hub_margin(a: DataFrame, b: DataFrame, hubs_a: DataFrame, hubs_b: DataFrame, margin: float = 0.2, temperature: float = 1.0) -> DataFrame:
    """(loss): mean similarity of pairs with exactly one hub, less that of pairs of hubs, plus a margin; at least 0.

    A sum of inner products is the inner product of sums, so no pair is formed.
    """

    def sums(side: DataFrame, hubs: DataFrame, c: str) -> DataFrame:
        marked = side.join(hubs.select("idx", F.lit(True).alias("hub")), "idx", "left").select(F.coalesce("hub", F.lit(False)).alias("hub"), F.col("z").cast("array<double>").alias("z"))
        scaled = marked.select("hub", F.posexplode(F.expr("transform(z, x -> coalesce(x / nullif(sqrt(aggregate(z, 0.0D, (s, y) -> s + y * y)), 0.0D), 0.0D))")).alias("pos", "x"))
        return scaled.groupBy("pos", "hub").agg(F.sum("x").alias(f"x{c}"), F.count("*").alias(f"n{c}")).withColumnRenamed("hub", f"hub_{c}")

    both = sums(a, hubs_a, "a").join(sums(b, hubs_b, "b"), "pos")
    by = both.groupBy("hub_a", "hub_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("sum"), F.max(F.col("na") * F.col("nb")).alias("n"))
    n = F.col("hub_a").cast("int") + F.col("hub_b").cast("int")
    mean = lambda k: F.sum(F.when(n == k, F.col("sum"))) / F.nullif(F.sum(F.when(n == k, F.col("n"))), F.lit(0)) / temperature
    return by.agg(F.greatest(mean(1) - mean(2) + margin, F.lit(0.0)).alias("loss"))


def rank_matches(wa: DataFrame, wb: DataFrame) -> DataFrame:
    """(a, b): for each a the b whose normalised weight rank is nearest, the smallest id among equals.

    Ranks of the other side are evenly spaced, so the nearest are found by their
    positions: three candidates a row, whatever the sizes.
    """
    def ranks(df: DataFrame, c: str) -> DataFrame:
        n = df.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias(f"n{c}"))
        return ordinal(df.withColumnRenamed("idx", "id"), "w", "at").crossJoin(n).select(F.col("id").alias(c), (F.col("at") - 1).alias(f"at{c}"), f"n{c}", ((F.col("at") - 1) / F.col(f"n{c}")).alias(f"r{c}"))

    right = ranks(wb, "b").drop("nb")
    size = wb.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("nb"))
    near = F.floor(F.col("ra") * F.col("nb"))
    left = ranks(wa, "a").crossJoin(size).select("a", "ra", F.explode(F.sequence(near - 1, near + 1)).alias("atb"))
    return left.join(right, "atb").groupBy("a").agg(F.min_by("b", F.struct(F.abs(F.col("ra") - F.col("rb")), "b")).alias("b"))


def centroid_similarity(a: DataFrame, b: DataFrame, keep_a: DataFrame, keep_b: DataFrame) -> DataFrame:
    """(sim): cosine of the mean vectors of the kept rows of either side."""
    mean = lambda side, keep, c: side.join(keep.select("idx"), "idx", "left_semi").select(F.posexplode("z").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias(c))
    both = mean(a, keep_a, "x").join(mean(b, keep_b, "y"), "pos")
    return both.agg((F.sum(F.col("x") * F.col("y")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), F.lit(0.0))).alias("sim"))


def prototypes(side: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(bin, pos, value): weighted centroids of k equal bins by descending weight."""
    bins = equal_bins(weights.withColumnRenamed("idx", "id"), "w", k).withColumnRenamed("id", "idx")
    rows = side.join(bins, "idx").select("bin", "w", F.posexplode("z").alias("pos", "x"))
    return rows.groupBy("bin", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))


def _units(side: DataFrame) -> DataFrame:
    z = side.select("idx", F.col("z").cast("array<double>").alias("z"))
    return z.select("idx", F.expr("transform(z, x -> coalesce(x / nullif(sqrt(aggregate(z, 0.0D, (s, y) -> s + y * y)), 0.0D), 0.0D))").alias("z"))


def _row_sums(a: DataFrame, b: DataFrame, temperature: float, width: float | None) -> DataFrame:
    """(idx, lse, mean, z, d, s) of each row of ``a`` over all rows of ``b``, from block products.

    ``lse`` is the log of the sum of exponentials of the logits and ``mean`` their
    mean; with a ``width``, t = exp(-|difference of ranks| / width) and ``z``, ``d``,
    ``s`` sum t, t * difference and t * logit.
    """

    def reduce(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        logit = blocks.unit(x["z"]) @ blocks.unit(y["z"]).T / temperature
        top = logit.max(1)
        gap = np.abs(x["r"].to_numpy()[:, None] - y["r"].to_numpy()[None, :])
        t = np.exp(-gap / (width or 1.0))
        sums = {"z": t.sum(1), "d": (t * gap).sum(1), "s": (t * logit).sum(1)}
        return pd.DataFrame({"idx": x["idx"], "top": top, "mass": np.exp(logit - top[:, None]).sum(1), "total": logit.sum(1), "n": len(y), **sums})

    parts = blocks.by_blocks(a, b, reduce, "idx bigint, top double, mass double, total double, n bigint, z double, d double, s double")
    parts = parts.withColumn("most", F.max("top").over(Window.partitionBy("idx")))
    lse = F.first("most") + F.log(F.sum(F.col("mass") * F.exp(F.col("top") - F.col("most"))))
    return parts.groupBy("idx").agg(lse.alias("lse"), (F.sum("total") / F.sum("n")).alias("mean"), *[F.sum(c).alias(c) for c in ("z", "d", "s")])


def _placed(side: DataFrame, weights: DataFrame) -> DataFrame:
    """(idx, z, w, at, r): place by descending weight from 0, and over the last place."""
    n = weights.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    ranked = ordinal(weights.select(F.col("idx").alias("id"), F.col("w").cast("double").alias("w")), "w", "at").crossJoin(F.broadcast(n))
    return _units(side).join(ranked.select(F.col("id").alias("idx"), "w", (F.col("at") - 1).alias("at"), ((F.col("at") - 1) / F.col("n")).alias("r")), "idx")


def role_alignment(
    a: DataFrame,
    wa: DataFrame,
    b: DataFrame,
    wb: DataFrame,
    temperature: float = 0.1,
    width: float = 0.15,
    ratio: float = 0.1,
    least: int = 5,
    most: int = 50,
    bins: int = 3,
    weights: tuple[float, float, float] = (1.0, 1.0, 0.5),
) -> DataFrame:
    """(loss_hub, loss_match, loss_prototype, loss_role): do nodes of like weight lie alike on both sides?

    ``loss_hub``: distance of the hubs' centres, and half the distance of hub
    logits from an even spread.  ``loss_match``: divergence of the logits from
    nearness of weight ranks, and half the mean distance to the row of nearest
    rank.  ``loss_prototype``: mean distance of the weighted centroids of equal
    bins of weight.  All rows take part.  Too few rows for a part give 0.
    """
    a, wa, b, wb = (stored(x) for x in (a.select("idx", "z"), wa.select("idx", "w"), b.select("idx", "z"), wb.select("idx", "w")))
    n = {k: side.count() for k, side in (("a", a), ("b", b))}
    hubs = min(max(least, min(most, int(n["a"] * ratio))), max(least, min(most, int(n["b"] * ratio))), *n.values())
    left, right = stored(_placed(a, wa)), stored(_placed(b, wb))
    first = lambda side: side.filter(F.col("at") < hubs)
    mean = lambda side, c: first(side).select(F.posexplode("z").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias(c))
    near = lambda x, y: F.sum(F.col(x) * F.col(y)) / F.nullif(F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col(y) * F.col(y))), F.lit(0.0))
    centre = mean(left, "x").join(mean(right, "y"), "pos").agg((1.0 - F.coalesce(near("x", "y"), F.lit(0.0))).alias("centre"))
    spread = _row_sums(first(left).select("idx", "z", "r"), first(right).select("idx", "z", "r"), temperature, None).agg(F.avg(F.col("lse") - F.col("mean")).alias("spread"))
    hub = centre.crossJoin(spread).select(F.when(F.lit(hubs >= 2), F.col("centre") + 0.5 * F.col("spread")).otherwise(0.0).alias("loss_hub"))
    sums = _row_sums(left.select("idx", "z", "r"), right.select("idx", "z", "r"), temperature, width)
    # sum of t / z * (log(t / z) - logit + lse) with log t = -difference / width
    diverge = sums.agg(F.avg(-F.col("d") / F.col("z") / width - F.log("z") - F.col("s") / F.col("z") + F.col("lse")).alias("kl"))
    matched = rank_matches(wa, wb).join(left.select(F.col("idx").alias("a"), F.col("z").alias("x")), "a").join(right.select(F.col("idx").alias("b"), F.col("z").alias("y")), "b")
    direct = matched.agg((1.0 - F.avg(dot(F.col("x"), F.col("y")))).alias("direct"))
    enough = F.lit(min(n.values()) >= 5)
    match = diverge.crossJoin(direct).select(F.when(enough, F.col("kl") + 0.5 * F.col("direct")).otherwise(0.0).alias("loss_match"))
    centroids = prototypes(_units(a), wa, bins).withColumnRenamed("value", "x").join(prototypes(_units(b), wb, bins).withColumnRenamed("value", "y"), ["bin", "pos"])
    distance = centroids.groupBy("bin").agg((1.0 - F.coalesce(near("x", "y"), F.lit(0.0))).alias("d")).agg(F.avg("d").alias("d"))
    proto = distance.select(F.when(F.lit(min(n.values()) >= bins), F.col("d")).otherwise(0.0).alias("loss_prototype"))
    rows = hub.crossJoin(match).crossJoin(proto)
    return rows.withColumn("loss_role", weights[0] * F.col("loss_hub") + weights[1] * F.col("loss_match") + weights[2] * F.col("loss_prototype"))


def total(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """(loss_<name> ..., loss_total): one-row losses, weighted and added; parts of weight 0 aren't evaluated and count 0."""
    rows = None
    for name, part in parts.items():
        if not weights.get(name):
            continue
        one = part.toDF(f"loss_{name}")
        rows = one if rows is None else rows.crossJoin(one)
    if rows is None:
        raise ValueError("no part has a weight")
    rows = rows.withColumns({f"loss_{n}": F.lit(0.0) for n in parts if not weights.get(n)})
    return rows.withColumn("loss_total", sum((F.col(f"loss_{n}") * w for n, w in weights.items() if w), F.lit(0.0)))
