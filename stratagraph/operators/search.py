"""Local search on seed sets: zones, marginal gains, layer performance, swaps, greedy construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def zones(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, dst): the nodes two hops away and the node itself."""
    return graph.two_hop(arcs).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))


def marginal_gain(nodes: DataFrame, arcs: DataFrame, influence: DataFrame, alpha: DataFrame, own: DataFrame, other: DataFrame, penalty: float = 0.5) -> DataFrame:
    """(node, gain) of nodes outside the own set: influence * alpha, discounted by the zone's overlap with the opponents' zones and, at 0.3, the own ones."""
    z = zones(nodes, arcs)
    covered = lambda s, name: z.join(s.select(F.col("node").alias("src")).distinct(), "src").select("dst").distinct().withColumn(name, F.lit(1))
    rows = z.join(covered(other, "o"), "dst", "left").join(covered(own, "m"), "dst", "left")
    share = rows.groupBy(F.col("src").alias("node")).agg((F.count("o") / F.count("*")).alias("o"), (F.count("m") / F.count("*")).alias("m"))
    free = share.join(own.select("node").distinct(), "node", "left_anti").join(influence, "node").join(alpha, "node")
    return free.select("node", (F.col("potential") * F.col("w") * (1.0 - penalty * F.col("o") - 0.3 * F.col("m"))).alias("gain"))


def layer_performance(nodes: DataFrame, arcs: DataFrame, influence: DataFrame, alpha: DataFrame, own: DataFrame) -> DataFrame:
    """(performance): influence * alpha over the union of the seeds' zones."""
    z = zones(nodes, arcs).join(own.select(F.col("node").alias("src")).distinct(), "src").select(F.col("dst").alias("node")).distinct()
    return z.join(influence, "node").join(alpha, "node").agg(F.coalesce(F.sum(F.col("potential") * F.col("w")), F.lit(0.0)).alias("performance"))


def balanced(first: DataFrame, second: DataFrame, weight: float = 0.5) -> DataFrame:
    """(p1, p2, fitness): two layers' performance, and their sum less the weighted difference."""
    both = first.select(F.col("performance").alias("p1")).crossJoin(second.select(F.col("performance").alias("p2")))
    return both.select("p1", "p2", (F.col("p1") + F.col("p2") - weight * F.abs(F.col("p1") - F.col("p2"))).alias("fitness"))


def top_candidates(values: DataFrame, own: DataFrame, k: int = 20) -> DataFrame:
    """(node, value): of the ``k`` nodes worth most, smaller ids first among equals, those outside the own set (k is the feature: a short list)."""
    best = values.orderBy(F.desc("value"), "node").limit(k)
    return best.join(own.select("node").distinct(), "node", "left_anti").select("node", "value")


def best_swap(own: DataFrame, gains: DataFrame, values: DataFrame) -> DataFrame:
    """(out_node, in_node, delta): the best single exchange by gain of what comes in less value of what goes; at most one row."""
    come = gains.select(F.col("node").alias("in_node"), "gain").orderBy(F.desc("gain"), "in_node").limit(1)
    go = own.select("node").distinct().join(values, "node").select(F.col("node").alias("out_node"), F.col("value")).orderBy("value", "out_node").limit(1)
    return go.crossJoin(come).select("out_node", "in_node", (F.col("gain") - F.col("value")).alias("delta"))


def greedy(nodes: DataFrame, arcs: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(pos, node, gain): k rounds of the node whose zone adds most uncovered weight, the smallest id among equals."""
    spark = nodes.sparkSession
    z = zones(nodes, arcs).join(weights.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "w")
    chosen: list[tuple] = []
    for i in range(k):
        left = z
        if chosen:
            picked = spark.createDataFrame([(c[1],) for c in chosen], "src bigint")
            covered = z.join(F.broadcast(picked), "src").select("dst").distinct()
            left = z.join(covered, "dst", "left_anti").join(F.broadcast(picked), "src", "left_anti")
        top = left.groupBy("src").agg(F.sum("w").alias("gain")).orderBy(F.desc("gain"), "src").limit(1).collect()
        if not top:
            break
        chosen.append((i + 1, top[0]["src"], top[0]["gain"]))
    return spark.createDataFrame(chosen, "pos int, node bigint, gain double")


def elite(df: DataFrame, k: int) -> DataFrame:
    """The k best of each skill by cost."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("cost"), "id"))).filter(F.col("rn") <= k).drop("rn")


def one_swap(own: list[int], other: list[int], candidates: list[int], arcs1: DataFrame, arcs2: DataFrame, least: int, p: float, steps: int) -> DataFrame:
    """(out_node, in_node, t1, t2, t3): every exchange of one own seed for a candidate, all three objectives measured in one pass."""
    from .evolve import evaluate

    spark = arcs1.sparkSession
    swaps = [(s, c) for s in dict.fromkeys(own) for c in candidates if c not in own]
    rows = [(i, [c if x == s else x for x in own], list(other)) for i, (s, c) in enumerate(swaps)]
    pop = spark.createDataFrame(rows, "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>")
    named = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(swaps)], "id bigint, out_node bigint, in_node bigint")
    return evaluate(pop, arcs1, arcs2, least, p, steps).join(named, "id").select("out_node", "in_node", "t1", "t2", "t3")
