"""Populations of seed-set pairs as tables: (id, seeds_l1, seeds_l2). Randomness is a hash of purpose, id and slot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..session import ship, stored
from . import ranking
from .kernel import Csr, tasks

TASKS = ["t1", "t2", "t3"]


def sample(spark: SparkSession, n: int, weights: DataFrame, k: int, purpose: str) -> DataFrame:
    """(id, seeds): for each of n ids, k nodes drawn by weight without replacement (largest ln(u) / w win)."""
    ids = spark.range(n)
    draw = F.log(F.greatest(uniform(purpose, F.col("id"), F.col("node")), F.lit(1e-12))) / F.col("w")
    rows = ids.crossJoin(weights.filter("w > 0")).select("id", "node", draw.alias("key"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("key"), "node"))).filter(F.col("rn") <= k)
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node"))), lambda x: x["node"]).alias("seeds"))


def population(spark: SparkSession, n: int, w1: DataFrame, w2: DataFrame, k1: int, k2: int, purpose: str = "pop") -> DataFrame:
    """n candidates, each side drawn by its layer's weights."""
    one = sample(spark, n, w1, k1, f"{purpose}:1").withColumnRenamed("seeds", "seeds_l1")
    two = sample(spark, n, w2, k2, f"{purpose}:2").withColumnRenamed("seeds", "seeds_l2")
    return one.join(two, "id")


def repair(genes: Column, n: int, k: int) -> Column:
    """In range, without repeats, order kept; filled up with the smallest unused ids, cut to k."""
    good = F.array_distinct(F.filter(genes, lambda x: (x >= 0) & (x < n)))
    spare = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(n - 1), F.lit(2 * k)).cast("bigint")), good)
    return F.slice(F.concat(good, spare), 1, k)


def single_point(pairs: DataFrame, side: str, n: int, k: int) -> DataFrame:
    """Both children of (pair_id, x, y) after swapping the tails of ``side`` at a hashed cut, repaired."""
    cut = (F.floor(uniform(f"cut:{side}", F.col("pair_id")) * F.greatest(F.lit(k - 1), F.lit(1))) + 1).cast("int")
    tail = lambda c: F.slice(c, cut + 1, F.lit(k))
    x, y = F.col("x"), F.col("y")
    return pairs.select("pair_id", repair(F.concat(F.slice(x, F.lit(1), cut), tail(y)), n, k).alias("c1"), repair(F.concat(F.slice(y, F.lit(1), cut), tail(x)), n, k).alias("c2"))


def tournament(df: DataFrame, rounds: int, purpose: str) -> DataFrame:
    """(round, id): of two hashed draws the fitter one, the first among equals."""
    n = df.agg(F.count("*").alias("n"))
    ranked = ranking.running(df.select("id", "fitness"), [F.asc("id")], slot=F.lit(1)).withColumn("slot", F.col("slot") - 1)
    r = df.sparkSession.range(rounds).withColumnRenamed("id", "round").crossJoin(n)
    first = F.floor(uniform(purpose, "0", F.col("round")) * F.col("n"))
    second = F.pmod(first + 1 + F.floor(uniform(purpose, "1", F.col("round")) * F.greatest(F.col("n") - 1, F.lit(1))), F.col("n"))
    draws = r.select("round", F.posexplode(F.array(first, second)).alias("turn", "slot"))
    return draws.join(ranked, "slot").groupBy("round").agg(F.max_by("id", F.struct("fitness", -F.col("turn"))).alias("id"))


def inject(df: DataFrame, weights: DataFrame, donated: int) -> DataFrame:
    """(id, seeds) of (id, genes, donors): the donors' best by weight replace as many of the weakest genes that aren't donated themselves."""
    best = df.select("id", F.posexplode("donors").alias("pos", "node")).join(weights, "node")
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "pos"))).filter(F.col("rn") <= donated)
    given = best.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("given"))
    own = df.select("id", F.posexplode("genes").alias("pos", "node")).join(weights, "node").join(best.select("id", "node"), ["id", "node"], "left_anti")
    kept = own.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "pos")))
    kept = kept.join(df.select("id", F.size("genes").alias("k")), "id").filter(F.col("rn") <= F.col("k") - donated)
    left = kept.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("left"))
    none = F.array().cast("array<bigint>")
    return df.select("id").join(given, "id", "left").join(left, "id", "left").select("id", F.sort_array(F.concat(F.coalesce("left", none), F.coalesce("given", none))).alias("seeds"))


def mutate(df: DataFrame, weights: DataFrame, rate: float, purpose: str) -> DataFrame:
    """(id, seeds) of (id, genes): each gene is replaced at the given rate by a weighted draw of an unused node; draws that meet keep the old gene."""
    genes = df.select("id", F.posexplode("genes").alias("pos", "node"))
    hit = genes.filter(uniform(f"{purpose}:hit", F.col("id"), F.col("pos")) < rate).select("id", "pos")
    ladder = ranking.running(weights.select("node", "w"), [F.asc("node")], hi=F.col("w"))
    size = F.broadcast(weights.agg(F.sum("w").alias("all"), F.count("*").alias("n")))  # one row
    # as many cells as nodes: a draw looks at the rungs of its cell only, a rung stands in each cell that it reaches
    cell = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / F.col("all"))) * F.col("n"))
    drawn = hit.crossJoin(size).withColumn("x", uniform(f"{purpose}:node", F.col("id"), F.col("pos")) * F.col("all")).withColumn("cell", cell(F.col("x")))
    rungs = ladder.crossJoin(size).select("node", "w", "hi", F.explode(F.sequence(cell(F.col("hi") - F.col("w")), cell(F.col("hi")))).alias("cell"))
    met = drawn.join(rungs, "cell").filter((F.col("x") >= F.col("hi") - F.col("w")) & (F.col("x") < F.col("hi")))
    new = met.groupBy("id", "pos").agg(F.min("node").alias("new"))
    new = new.join(genes.select("id", F.col("node").alias("new")), ["id", "new"], "left_anti")
    new = new.groupBy("id", "new").agg(F.min("pos").alias("pos"))
    out = genes.join(new, ["id", "pos"], "left").select("id", "pos", F.coalesce("new", "node").alias("node"))
    return out.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("seeds"))


def tempered(weights: DataFrame, temperature: float = 1.0, excluded: DataFrame | None = None) -> DataFrame:
    """(node, w): weights to the power 1 / temperature, excluded nodes at 0; a temperature other than 1 first lifts every weight to 1e-10, so excluded nodes can be drawn again."""
    rows = weights if excluded is None else weights.join(excluded.select("node").distinct().withColumn("_out", F.lit(True)), "node", "left").select("node", F.when(F.col("_out"), 0.0).otherwise(F.col("w")).alias("w"))
    return rows if temperature == 1.0 else rows.select("node", F.pow(F.greatest("w", F.lit(1e-10)), F.lit(1.0 / temperature)).alias("w"))


def matched(spark: SparkSession, n: int, pairs: DataFrame, k: int, purpose: str) -> DataFrame:
    """(id, seeds_l1, seeds_l2): for each of n ids the reported pairs (a, b) in a hashed order, each taken whose nodes aren't taken yet, up to k.

    ``pairs`` is a report of bounded length (``blocks.best_pairs``): an id's pairs fit a row.
    """
    dealt = spark.range(n).crossJoin(F.broadcast(pairs.select("a", "b")))
    order = F.array_sort(F.collect_list(F.struct(uniform(purpose, F.col("id"), F.col("a"), F.col("b")).alias("key"), "a", "b"))).alias("order")
    none = F.array().cast("array<bigint>")
    free = lambda s, x: (F.size(s["one"]) < k) & ~F.array_contains(s["one"], x["a"]) & ~F.array_contains(s["two"], x["b"])
    taken = lambda s, x: F.struct(F.array_append(s["one"], x["a"]).alias("one"), F.array_append(s["two"], x["b"]).alias("two"))
    step = lambda s, x: F.when(free(s, x), taken(s, x)).otherwise(s)
    got = dealt.groupBy("id").agg(order).select("id", F.aggregate("order", F.struct(none.alias("one"), none.alias("two")), step).alias("got"))
    return got.select("id", F.col("got.one").alias("seeds_l1"), F.col("got.two").alias("seeds_l2"))


def groups(spark: SparkSession, n: int, shares: dict[str, float], rest: str, purpose: str = "group") -> DataFrame:
    """(id, group, pos): n ids in groups of int(n * share) in the order given, ``rest`` takes what is left; pos is a hashed order of all."""
    ends, at = [], 0
    for name, share in shares.items():
        at += int(n * share)
        ends.append((name, at))
    which = F.lit(rest)
    for name, end in reversed(ends):
        which = F.when(F.col("id") < end, name).otherwise(which)
    rows = spark.range(n).select("id", which.alias("group"), uniform(purpose, F.col("id")).alias("key"))
    return ranking.ordinal(rows, "key", "pos", descending=False).select("id", "group", "pos")


def mating(pairs: DataFrame, crossing: float, across: float, purpose: str = "mating") -> DataFrame:
    """(pair_id, skill_x, skill_y, mode) of (pair_id, skill_x, skill_y): ``copy`` unless a coin says to cross; equal skills swap tails (``swap``), others guide each other (``guided``) at the rate ``across``."""
    u = lambda c: uniform(f"{purpose}:{c}", F.col("pair_id"))
    mode = F.when(u("cross") >= crossing, "copy").when(F.col("skill_x") == F.col("skill_y"), "swap").when(u("across") < across, "guided").otherwise("copy")
    return pairs.select("pair_id", "skill_x", "skill_y", mode.alias("mode"))


def neighbour_mutation(df: DataFrame, near: DataFrame, weights: DataFrame, rate: float, purpose: str) -> DataFrame:
    """(id, pos, node) of (id, genes): at the given rate a gene gives way to its neighbour (a, b) of most weight that isn't a gene; of two that meet the later one stays as it was."""
    genes = df.select("id", F.posexplode("genes").alias("pos", "node"))
    hit = genes.filter(uniform(f"{purpose}:near", F.col("id"), F.col("pos")) < rate)
    ways = hit.join(near.select(F.col("a").alias("node"), F.col("b").alias("new")), "node").join(genes.select("id", F.col("node").alias("new")).distinct(), ["id", "new"], "left_anti")
    ways = ways.join(weights.select(F.col("node").alias("new"), "w"), "new")
    best = ways.groupBy("id", "pos").agg(F.max_by("new", F.struct("w", -F.col("new"))).alias("new"))
    best = best.groupBy("id", "new").agg(F.min("pos").alias("pos"))
    return genes.join(best, ["id", "pos"], "left").select("id", "pos", F.coalesce("new", "node").alias("node"))


#: Nodes of best score of each layer that tasks know beside the candidates' seeds.
WIDTH = 256


def _best_scored(arcs: DataFrame, width: int) -> tuple[list[int], tuple[int, int] | None]:
    """The ``width`` nodes of best two-hop score, all neighbours counted, and (score, node) of the next one, if any."""
    deg = arcs.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("deg"))
    score = arcs.join(deg, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(1 + F.col("deg")).alias("score"))
    rows = score.orderBy(F.desc("score"), "node").limit(width + 1).collect()  # a short list
    return [r["node"] for r in rows[:width]], ((rows[width]["score"], rows[width]["node"]) if len(rows) > width else None)


def _around(arcs: DataFrame, core: list[int]) -> list[np.ndarray]:
    """The arcs out of the core, out of its neighbours, and back: scores of the core and degrees next to it are whole in them."""
    at = F.broadcast(arcs.sparkSession.createDataFrame([(v,) for v in core], "src bigint"))
    first = at.join(arcs.select("src", "dst"), "src").select(F.col("dst").alias("src")).union(at).distinct()
    out = stored(arcs.select("src", "dst").join(first, "src"))
    rows = out.union(out.select("dst", "src")).distinct().toArrow()  # as many as the core's surroundings have, 16 bytes each
    return [rows.column(c).to_numpy() for c in ("src", "dst")]


def evaluate(pop: DataFrame, arcs1: DataFrame, arcs2: DataFrame, least: int, p: float, steps: int, width: int = WIDTH) -> DataFrame:
    """The candidates with t1, t2 and t3, spread over all tasks; ``least`` is the smallest node.

    Tasks get what lies around the candidates' seeds and the ``width`` nodes of best
    score, never a layer.  Scores only fall and seeds only hide neighbours, so the next
    node's score bounds all that is left out; a candidate whose attack comes down to it
    is measured again with a list four times as long.
    """
    spark = pop.sparkSession
    ship(spark)
    shape = "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>, t1 double, t2 double, t3 double"
    pop = stored(pop.select("id", "seeds_l1", "seeds_l2"))
    seeds = {int(v) for r in pop.collect() for c in ("seeds_l1", "seeds_l2") for v in r[c]}  # a population's genes
    known = []
    for arcs in (arcs1, arcs2):
        best, bound = _best_scored(arcs, max(width, steps))
        known.append((*_around(arcs, sorted({*best, *seeds, least})), bound))
    ids = np.unique(np.concatenate([np.array(sorted({*seeds, least}), np.int64), *[x for src, dst, _ in known for x in (src, dst)]]))
    graphs = tuple(Csr(len(ids), np.searchsorted(ids, src), np.searchsorted(ids, dst)) for src, dst, _ in known)
    # places keep the order of ids; a node left out that is no smaller than the bound's stands at or after its place
    ends = tuple(None if bound is None else (bound[0], -int(np.searchsorted(ids, bound[1]))) for _, _, bound in known)
    held = spark.sparkContext.broadcast((ids, graphs, ends))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, (a, b), ends = held.value
        place = lambda x: np.searchsorted(ids, np.array(list(x), np.int64)).tolist()
        for part in parts:
            t = [tasks(a, b, place(x), place(y), p, steps, steps, ends) for x, y in zip(part["seeds_l1"], part["seeds_l2"])]
            yield part[["id", "seeds_l1", "seeds_l2"]].assign(**{k: np.array([r[i] for r in t], float) for i, k in enumerate(TASKS)})

    done = stored(pop.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, shape))
    held.destroy()  # the scores are written; a search would pile up one a generation
    open_ = F.col("t1").isNull() | F.col("t2").isNull()  # not a number comes back as null
    if done.filter(open_).isEmpty():
        return done
    return done.filter(~open_).unionByName(evaluate(done.filter(open_), arcs1, arcs2, least, p, steps, 4 * width))


def search(spark: SparkSession, n_nodes: int, arcs1: DataFrame, arcs2: DataFrame, w1: DataFrame, w2: DataFrame, size: int = 12, generations: int = 3, k: int = 5, p: float = 0.01, steps: int = 3, rate: float = 0.2) -> DataFrame:
    """(gen, best_t1, best_t2, best_t3, mean_fitness): the running best of each task over a multi-task search.

    Parents and offspring are ranked apart, and meet in one survival pool.
    """
    arcs1, arcs2 = stored(arcs1), stored(arcs2)
    # rows of all nodes: written once, and joined by shuffles, since they are far larger than their compressed files tell
    w1, w2 = (stored(w.select("node", "w")).hint("merge") for w in (w1, w2))
    least = w1.agg(F.min("node")).collect()[0][0]

    def ranked(df: DataFrame) -> list:
        return ranking.skill_factors(df, TASKS).collect()  # a population: ``size`` rows

    parents = ranked(evaluate(population(spark, size, w1, w2, k, k), arcs1, arcs2, least, p, steps))
    weights = stored(w1.join(w2.withColumnRenamed("w", "w2"), "node").select("node", ((F.col("w") + F.col("w2")) / 2).alias("w")))
    history = []
    best = dict.fromkeys(TASKS, float("-inf"))
    shape = "id bigint, seeds_l1 array<bigint>, seeds_l2 array<bigint>, t1 double, t2 double, t3 double, rank_t1 bigint, rank_t2 bigint, rank_t3 bigint, skill int, fitness double"
    for gen in range(generations + 1):
        best = {t: max(best[t], *[r[t] for r in parents]) for t in TASKS}
        history.append((gen, best["t1"], best["t2"], best["t3"], sum(r["fitness"] for r in parents) / len(parents)))
        if gen == generations:
            break
        pool = spark.createDataFrame([tuple(r) for r in parents], shape)
        picks = tournament(pool, size + size % 2, f"mate:{gen}").join(pool.select("id", "seeds_l1", "seeds_l2"), "id")
        mates = picks.withColumn("pair_id", F.floor(F.col("round") / 2)).groupBy("pair_id").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("round", c))), lambda x: x[c]).alias(c) for c in ("seeds_l1", "seeds_l2")])
        children = None
        for side in ("seeds_l1", "seeds_l2"):
            kids = single_point(mates.select(F.concat(F.lit(f"{gen}:"), F.col("pair_id")).alias("pair_id"), F.col(side)[0].alias("x"), F.col(side)[1].alias("y")), side, n_nodes, k)
            kids = kids.select(F.col("pair_id"), F.posexplode(F.array("c1", "c2")).alias("turn", "genes"))
            kids = kids.select((F.element_at(F.split("pair_id", ":"), 2).cast("bigint") * 2 + F.col("turn") + size * (gen + 1)).alias("id"), "genes")
            kids = mutate(kids, weights, rate, f"mut:{side}:{gen}").withColumnRenamed("seeds", side)
            children = kids if children is None else children.join(kids, "id")
        offspring = ranked(evaluate(children, arcs1, arcs2, least, p, steps))
        best = {t: max(best[t], *[r[t] for r in offspring]) for t in TASKS}
        both = spark.createDataFrame([tuple(r) for r in [*parents, *offspring]], shape)
        cost = F.when(F.col("skill") == 1, F.col("t1")).when(F.col("skill") == 2, F.col("t2")).otherwise(F.col("t3"))
        parents = ranking.survival(both.withColumn("cost", cost), size).drop("tier", "pos", "cost").collect()
    return spark.createDataFrame(history, "gen int, best_t1 double, best_t2 double, best_t3 double, mean_fitness double")
