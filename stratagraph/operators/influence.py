"""Two-hop influence of seed lists, attacks and robustness. Seeds are lists: a repeated seed counts each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uniform
from ..session import stored
from . import graph

#: Arcs of a layer up to which some operators send it to a task whole (16 bytes an arc).
MAX_ARCS = 20_000_000


def _weights(nodes: DataFrame, weights: DataFrame | None) -> DataFrame:
    rows = nodes.select("node", F.lit(1.0).alias("w")) if weights is None else weights.select("node", "w")
    return rows.hint("merge")  # a row a node: far larger than its compressed file tells, so it is joined by shuffles


def rescaled(weights: DataFrame) -> DataFrame:
    """Weights with mean 1."""
    mean = weights.agg(F.avg("w").alias("mean"))
    return weights.crossJoin(mean).select("node", (F.col("w") / F.col("mean")).alias("w"))


def _total(df: DataFrame, column, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias(name))


def side(own: DataFrame, other: DataFrame | None, nodes: DataFrame, arcs: DataFrame, p: float, weights: DataFrame | None = None, removed: DataFrame | None = None, name: str = "a") -> DataFrame:
    """One row: two-hop influence of the seeds ``own`` beside the opponent's, ``other``.

    The weight of each seed, alive or not; its live neighbours and theirs,
    opponents excluded, at p and p squared; less, for every neighbour that is
    itself an own seed, its weight and degree, the degree halved (whole) once
    for each live opponent next to it.
    """
    w = _weights(nodes, weights)
    live = graph.active(arcs, removed)
    seeds = own.select(F.col("node").alias("src"))
    free = live
    if other is not None:
        free = live.join(other.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")
    weigh = w.withColumnRenamed("node", "dst")
    reach = free.join(weigh, "dst").groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("beyond"))
    hop = seeds.join(free, "src").join(weigh, "dst").join(reach, "dst", "left")
    gain = _total(hop, p * (F.col("w") + p * F.coalesce("beyond", F.lit(0.0))), "gain")
    base = _total(own.join(w, "node"), "w", "base")
    inner = seeds.join(free, "src").join(own.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    deg = live.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("deg"))
    cut = inner.join(deg, "dst").join(weigh, "dst")
    if other is not None:
        near = live.join(other.select(F.col("node").alias("src")).distinct(), "src").groupBy("dst").agg(F.count("*").alias("m"))
        cut = cut.join(near, "dst", "left")
        halved = F.floor(F.col("deg") / F.pow(F.lit(2.0), F.coalesce("m", F.lit(0))))
    else:
        halved = F.col("deg")
    loss = _total(cut, p * F.col("w") * (1.0 + p * halved), "loss")
    return base.crossJoin(gain).crossJoin(loss).select((F.col("base") + F.col("gain") - F.col("loss")).alias(name))


def two_hop(seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, p: float = 0.01, weights: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(influence) of one seed list without an opponent; weights as they are."""
    return side(seeds, None, nodes, arcs, p, weights, removed, "influence")


def competitive(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs: DataFrame, p: float = 0.01, weights_a: DataFrame | None = None, weights_b: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(total, a, b) of two competing seed lists; weights are rescaled to mean 1."""
    wa = None if weights_a is None else rescaled(weights_a)
    wb = None if weights_b is None else rescaled(weights_b)
    both = side(a, b, nodes, arcs, p, wa, removed, "a").crossJoin(side(b, a, nodes, arcs, p, wb, removed, "b"))
    return both.select((F.col("a") + F.col("b")).alias("total"), "a", "b")


def potential(nodes: DataFrame, arcs: DataFrame, p: float = 0.01) -> DataFrame:
    """(node, potential): 1 + p * degree + p^2 * sum of the neighbours' degrees."""
    deg = graph.degree(nodes, arcs)
    around = arcs.join(deg.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("deg").alias("around"))
    return deg.join(around, "node", "left").select("node", (1.0 + p * F.col("deg") + p * p * F.coalesce("around", F.lit(0))).alias("potential"))


def activation(seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, p: float = 0.01, blocked: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(node, prob): 1 for live seeds, else p for each arc and p^2 for each two-arc path from a seed, at most 1."""
    live = graph.active(arcs, removed)
    dead = removed if blocked is None else blocked if removed is None else blocked.select("node").union(removed.select("node")).distinct()
    live = graph.active(live, blocked)
    start = seeds.select("node") if dead is None else seeds.select("node").join(dead.select("node"), "node", "left_anti")
    one = start.withColumnRenamed("node", "src").join(live, "src").select("src", "dst")
    two = one.select(F.col("src").alias("s"), F.col("dst").alias("src")).join(live, "src").filter("dst <> s")
    paths = one.select(F.col("dst").alias("node"), F.lit(p).alias("x")).unionByName(two.select(F.col("dst").alias("node"), F.lit(p * p).alias("x")))
    sums = paths.groupBy("node").agg(F.sum("x").alias("x"))
    mine = start.distinct().withColumn("seed", F.lit(True))
    prob = F.when(F.col("seed"), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("x", F.lit(0.0))))
    return nodes.join(sums, "node", "left").join(mine, "node", "left").select("node", prob.alias("prob"))


def attack_scores(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs: DataFrame, mode: str = "2hop", removed: DataFrame | None = None) -> DataFrame:
    """(node, score): what an attacker sees; a node of one side doesn't count neighbours of the other, others count neither side's."""
    live = graph.active(arcs, removed)
    deg = graph.degree(nodes, live)
    if mode == "degree":
        return deg.select("node", F.col("deg").cast("double").alias("score"))
    if mode == "random":
        n = nodes.agg(F.count("*").alias("n"))
        return nodes.crossJoin(n).select("node", F.floor(uniform("attack", F.col("node")) * F.col("n")).cast("double").alias("score"))
    if mode != "2hop":
        raise ValueError(f"unknown attack mode {mode!r}")
    sides = a.select("node", F.lit(1).alias("s")).union(b.select("node", F.lit(2).alias("s")))
    sides = sides.groupBy("node").agg(F.bit_or("s").alias("s"))
    tag = lambda c, s: sides.select(F.col("node").alias(c), F.col("s").alias(s))
    seen = live.join(tag("src", "own"), "src", "left").join(tag("dst", "its"), "dst", "left").join(deg.withColumnRenamed("node", "dst"), "dst")
    own, its = F.coalesce("own", F.lit(0)), F.coalesce("its", F.lit(0))
    block = F.when(own.bitwiseAND(F.lit(1)) > 0, 2).when(own == 2, 1).otherwise(3)
    sums = seen.filter(its.bitwiseAND(block) == 0).groupBy(F.col("src").alias("node")).agg(F.sum(1.0 + F.col("deg")).alias("score"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def steps_of(n: int, steps: int | None = None, ratio: float | None = None) -> int:
    """Attack steps of n nodes: as given, else the ratio's share rounded half to even, else one a node."""
    if steps is not None:
        return max(0, int(steps))
    return n if ratio is None else max(0, round(n * ratio))


def degree_attacks(seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, steps: int) -> DataFrame:
    """(influence): mean over so many removals of the live node of highest degree of how many nodes the seeds and their live neighbours are; removed seeds count."""
    arcs = stored(arcs)
    gone: list[int] = []
    met = 0
    for _ in range(steps):
        removed = nodes.sparkSession.createDataFrame([(g,) for g in gone], "node bigint") if gone else None
        left = nodes if removed is None else nodes.join(F.broadcast(removed), "node", "left_anti")
        top = graph.degree(left, graph.active(arcs, removed)).orderBy(F.desc("deg"), "node").limit(1).collect()
        if not top:
            break
        gone.append(top[0]["node"])
        live = graph.active(arcs, nodes.sparkSession.createDataFrame([(g,) for g in gone], "node bigint"))
        around = live.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"))
        met += seeds.select("node").union(around).distinct().count()
    return nodes.sparkSession.createDataFrame([(met / steps if steps else 0.0,)], "influence double")


def attacked(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs: DataFrame, steps: int, mode: str = "2hop") -> DataFrame:
    """(step, node): who is removed at each of the first steps; the best score, the smallest id among equals.

    One short job a step (the chosen node is a scalar of the loop); meant for
    few steps.  ``attack.removals`` takes rounds of many steps.
    """
    spark = nodes.sparkSession
    gone: list[int] = []
    for _ in range(steps):
        removed = spark.createDataFrame([(g,) for g in gone], "node bigint") if gone else None
        top = attack_scores(a, b, nodes, arcs, mode, removed).orderBy(F.desc("score"), "node").limit(1).collect()
        if not top:
            break
        gone.append(top[0]["node"])
    return spark.createDataFrame([(i + 1, g) for i, g in enumerate(gone)], "step int, node bigint")


def robust_plan(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs: DataFrame, p: float, steps: int, weights_a: DataFrame | None = None, weights_b: DataFrame | None = None) -> DataFrame:
    """(total, a, b) of ``attack.robust``, step by step: some jobs a step, the plain form that it is held against."""
    path = attacked(a, b, nodes, arcs, steps).orderBy("step").collect()
    spark = nodes.sparkSession
    out = None
    for i in range(len(path)):
        removed = spark.createDataFrame([(r["node"],) for r in path[: i + 1]], "node bigint")
        row = competitive(a, b, nodes, arcs, p, weights_a, weights_b, removed)
        out = row if out is None else out.unionByName(row)
    if out is None:
        return spark.createDataFrame([(0.0, 0.0, 0.0)], "total double, a double, b double")
    return out.agg(*[F.avg(c).alias(c) for c in ("total", "a", "b")])
