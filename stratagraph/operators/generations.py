"""Guided generations: a population stays a table (id, seeds_l1, seeds_l2, ...) from its parents to its survivors.

A generation explodes genes once to meet weights and counterparts; crossing and
repair then work inside a candidate's row, whose size is the budget. Random nodes
are proposed by alias tables, so no candidate meets all nodes. Each generation
is written once for the offspring and once for the survivors; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform
from ..session import stored
from . import evolve, ranking
from .alias import Tables

SIDES = ("seeds_l1", "seeds_l2")


@dataclass(frozen=True)
class Rates:
    """How often pairs cross at all, parents of two skills meet, guided crossing happens between them, and a gene mutates at random or to a neighbour; ``share`` of the budget is handed over."""

    crossing: float = 0.7
    across: float = 0.3
    guided: float = 0.3
    share: float = 0.3
    random: float = 0.1
    near: float = 0.1
    tries: int = 16


class Guide:
    """What a search knows of both layers (side 0 and 1), written once.

    ``facts(side, node, w, to)``: weights, and the counterpart on the other layer
    where that layer has it; ``near(side, node, options)``: neighbours, those of
    most weight first. Weights are (node, w), counterparts and neighbours (a, b).
    """

    def __init__(self, weights: tuple[DataFrame, DataFrame], counterparts: tuple[DataFrame, DataFrame], near: tuple[DataFrame, DataFrame]):
        on = lambda dfs: dfs[0].withColumn("side", F.lit(0)).unionByName(dfs[1].withColumn("side", F.lit(1)))
        w = stored(on([d.select("node", F.col("w").cast("double").alias("w")) for d in weights]))
        there = w.select((1 - F.col("side")).alias("side"), F.col("node").alias("to"))
        to = on([d.select(F.col("a").alias("node"), F.col("b").alias("to")) for d in counterparts]).join(there, ["side", "to"])
        self.facts = stored(w.join(to.select("side", "node", "to"), ["side", "node"], "left").select("side", "node", "w", "to"))
        ways = on([d.select(F.col("a").alias("node"), F.col("b").alias("option")) for d in near]).join(w.withColumnRenamed("node", "option"), ["side", "option"])
        best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("key"), "option"))), lambda o: o["option"])
        self.near = stored(ways.groupBy("side", "node").agg(best.alias("options")))
        self.tables = Tables(w.select(F.col("side").cast("bigint").alias("src"), F.col("node").alias("dst"), "w"))

    def reserve(self, budgets: tuple[int, int], purpose: str) -> DataFrame:
        """(spare): for each side twice its budget of nodes, in a hashed order; one row."""
        parts = []
        for side, k in enumerate(budgets):
            key = uniform(purpose, F.lit(side), F.col("node"))
            mine = self.facts.filter(F.col("side") == side).orderBy(key, "node").limit(2 * k)
            parts.append(mine.agg(F.lit(side).alias("side"), F.sort_array(F.collect_list("node")).alias("nodes")))
        return parts[0].unionByName(parts[1]).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "nodes"))), lambda s: s["nodes"]).alias("spare"))

    def proposals(self, rows: DataFrame, keys: list[str], tries: int, purpose: str) -> DataFrame:
        """(keys, options): ``tries`` weighted draws for each row, in their order; rows name their ``side``."""
        tried = rows.select(*keys).withColumn("_at", F.col("side").cast("bigint")).withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        draws = [uniform(f"{purpose}:{c}", *[F.col(k) for k in keys], F.col("_try")) for c in ("chunk", "slot")]
        got = self.tables.step(tried, "_at", *draws)
        return got.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_try", "next"))), lambda o: o["next"]).alias("options"))


def _contest(rows: DataFrame, slots: DataFrame, purpose: str) -> DataFrame:
    """(pair_id, id, skill): of two different draws among slots lo + 1 to lo + n the fitter one, the first among equals; a single slot wins alone."""
    first = F.floor(uniform(f"{purpose}:0", F.col("pair_id")) * F.col("n"))
    second = F.pmod(first + 1 + F.floor(uniform(f"{purpose}:1", F.col("pair_id")) * F.greatest(F.col("n") - 1, F.lit(1))), F.col("n"))
    draws = rows.select("pair_id", F.posexplode(F.array(F.col("lo") + 1 + first, F.col("lo") + 1 + second)).alias("turn", "slot"))
    won = draws.join(slots, "slot").groupBy("pair_id").agg(F.max_by(F.struct("id", "skill"), F.struct("fitness", -F.col("turn"))).alias("won"))
    return won.select("pair_id", "won.*")


def parents(pop: DataFrame, n_pairs: int, across: float, purpose: str) -> DataFrame:
    """(pair_id, x, skill_x, y, skill_y) from (id, skill, fitness): at the rate ``across`` two different skills, each by a contest of its own, else a contest among all and one among the winner's skill.

    With one skill only, all pairs are of the second kind. An empty population has no pairs.
    """
    slots = stored(ranking.running(pop.select("id", "skill", "fitness"), [F.asc("skill"), F.asc("id")], slot=F.lit(1).cast("bigint")))
    sizes = pop.groupBy("skill").agg(F.count("*").alias("n"))
    spans = sizes.select("skill", "n", (F.sum("n").over(Window.orderBy("skill")) - F.col("n")).alias("lo"))  # a row a skill
    spans = F.broadcast(spans.agg(F.array_sort(F.collect_list(F.struct("skill", "lo", "n"))).alias("spans"), F.sum("n").alias("all")).filter("all > 0"))
    m = F.size("spans")
    i = F.floor(uniform(f"{purpose}:one", F.col("pair_id")) * m).cast("int")
    j = F.pmod(i + 1 + F.floor(uniform(f"{purpose}:two", F.col("pair_id")) * F.greatest(m - 1, F.lit(1))), m).cast("int")
    rows = pop.sparkSession.range(n_pairs).withColumnRenamed("id", "pair_id").crossJoin(spans)
    rows = rows.withColumn("apart", (uniform(f"{purpose}:apart", F.col("pair_id")) < across) & (m > 1)).withColumns({"i": i, "j": j})
    of = lambda k, c: F.get("spans", k)[c]
    first = rows.select("pair_id", F.when(F.col("apart"), of(F.col("i"), "lo")).otherwise(0).alias("lo"), F.when(F.col("apart"), of(F.col("i"), "n")).otherwise(F.col("all")).alias("n"))
    x = stored(_contest(first, slots, f"{purpose}:x").toDF("pair_id", "x", "skill_x"))
    rows = rows.join(x, "pair_id")
    same = lambda c: F.get(F.filter("spans", lambda s: s["skill"] == F.col("skill_x")), F.lit(0))[c]
    second = rows.select("pair_id", *[F.when(F.col("apart"), of(F.col("j"), c)).otherwise(same(c)).alias(c) for c in ("lo", "n")])
    return x.join(_contest(second, slots, f"{purpose}:y").toDF("pair_id", "y", "skill_y"), "pair_id")


def described(pop: DataFrame, guide: Guide) -> DataFrame:
    """(id, genes): both sides' genes as arrays of (pos, node, w, to); genes that the layer lacks are left out."""
    rows = pop.select("id", F.posexplode(F.array(*SIDES)).alias("side", "list")).select("id", "side", F.posexplode("list").alias("pos", "node"))
    rows = rows.join(guide.facts, ["side", "node"])
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "node", "w", "to"))))
    known = rows.groupBy("id").agg(F.array(side(0), side(1)).alias("genes"))
    none = F.array(*[F.array().cast("array<struct<pos:int,node:bigint,w:double,to:bigint>>")] * 2)
    return pop.select("id").join(known, "id", "left").select("id", F.coalesce("genes", none).alias("genes"))


def _nodes(genes: Column) -> Column:
    return F.transform(genes, lambda g: g["node"])


def _injected(base: Column, own: Column, other: Column, own_most: int, other_most: int) -> Column:
    """The donor's best genes of this side and the counterparts of its best of the other one take the places of the weakest genes, one each, repeats and genes at hand left out."""
    best = lambda genes, k: F.slice(F.array_sort(F.transform(genes, lambda g: F.struct((-g["w"]).alias("key"), g["pos"].alias("pos"), g["node"].alias("node"), g["to"].alias("to")))), 1, k)
    offered = F.concat(_nodes(best(own, own_most)), F.transform(best(other, other_most), lambda g: g["to"]))
    new = F.array_except(F.array_distinct(F.filter(offered, lambda v: v.isNotNull())), _nodes(base))
    n = F.least(F.size(new), F.size(base))
    weak = F.slice(F.array_sort(F.transform(base, lambda g: F.struct(g["w"].alias("w"), g["pos"].alias("pos"), g["node"].alias("node")))), F.lit(1), n)
    return F.concat(F.array_except(_nodes(base), _nodes(weak)), F.slice(new, F.lit(1), n))


def repaired(genes: Column, side: int, k: int, purpose: str) -> Column:
    """Without repeats, order kept, cut to k or filled up from the row's ``spare`` nodes in a hashed order; ``id`` names the row."""
    good = F.slice(F.array_distinct(genes), 1, k)
    order = F.array_sort(F.transform(F.get("spare", F.lit(side)), lambda v: F.struct(uniform(f"{purpose}:fill", F.col("id"), F.lit(side), v).alias("key"), v.alias("node"))))
    return F.slice(F.concat(good, F.array_except(_nodes(order), good)), 1, k)


def children(pop: DataFrame, pairs: DataFrame, guide: Guide, budgets: tuple[int, int], rates: Rates, purpose: str, first_id: int = 0) -> DataFrame:
    """(id, seeds_l1, seeds_l2, mode): two of each pair, copied, with swapped tails, or guided by counterparts (``evolve.mating``)."""
    genes = stored(described(pop, guide))
    modes = evolve.mating(pairs, rates.crossing, rates.guided, f"{purpose}:mating").select("pair_id", "mode")
    rows = pairs.join(modes, "pair_id").join(genes.toDF("x", "gx"), "x").join(genes.toDF("y", "gy"), "y")
    turns = {0: ("gx", "gy"), 1: ("gy", "gx")}
    made = []
    for turn, (base, donor) in turns.items():
        sides = []
        for side, k in enumerate(budgets):
            b, d, far = F.get(base, F.lit(side)), F.get(donor, F.lit(side)), F.get(donor, F.lit(1 - side))
            cut = (F.floor(uniform(f"{purpose}:cut:{side}", F.col("pair_id")) * F.greatest(F.size(F.get("gx", F.lit(side))) - 1, F.lit(1))) + 1).cast("int")
            tails = F.concat(F.slice(_nodes(b), F.lit(1), cut), F.slice(_nodes(d), cut + 1, F.lit(k)))
            swapped = F.when((F.size(b) == 0) | (F.size(d) == 0), _nodes(b)).otherwise(tails)
            handed = [max(1, int(q * rates.share)) for q in budgets]
            guided = _injected(b, d, far, handed[side], handed[1 - side])
            sides.append(F.when(F.col("mode") == "swap", swapped).when(F.col("mode") == "guided", guided).otherwise(_nodes(b)).alias(SIDES[side]))
        made.append(F.struct((F.col("pair_id") * 2 + turn + first_id).alias("id"), *sides))
    rows = rows.select("mode", F.explode(F.array(*made)).alias("child")).select("child.*", "mode")
    rows = rows.crossJoin(F.broadcast(guide.reserve(budgets, f"{purpose}:reserve")))
    return rows.select("id", *[repaired(F.col(c), s, budgets[s], purpose).alias(c) for s, c in enumerate(SIDES)], "mode")


def mutated(pop: DataFrame, guide: Guide, rates: Rates, purpose: str) -> DataFrame:
    """The rows of (id, seeds_l1, seeds_l2, ...) after mutation, gene by gene: at the rate ``random`` the first of ``tries`` weighted draws that isn't a gene by then, at ``near`` the heaviest such neighbour; without one a gene stays."""
    lists = pop.select("id", F.posexplode(F.array(*SIDES)).alias("side", "genes"))
    rows = lists.select("id", "side", F.posexplode("genes").alias("pos", "node")).withColumn("u", uniform(f"{purpose}:rate", F.col("id"), F.col("side"), F.col("pos")))
    rows = stored(rows.filter(F.col("u") < rates.random + rates.near))
    drawn = guide.proposals(rows.filter(F.col("u") < rates.random), ["id", "side", "pos"], rates.tries, purpose)
    close = rows.filter(F.col("u") >= rates.random).join(guide.near, ["side", "node"]).select("id", "side", "pos", "options")
    hits = drawn.unionByName(close).groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "options"))).alias("hits"))

    def step(now: Column, hit: Column) -> Column:
        new = F.get(F.filter(hit["options"], lambda o: ~F.array_contains(now, o)), F.lit(0))
        return F.when(new.isNull(), now).otherwise(F.transform(now, lambda g, i: F.when(i == hit["pos"], new).otherwise(g)))

    none = F.array().cast("array<struct<pos:int,options:array<bigint>>>")
    new = lists.join(hits, ["id", "side"], "left").select("id", "side", F.aggregate(F.coalesce("hits", none), F.col("genes"), step).alias("genes"))
    sides = [F.max(F.when(F.col("side") == s, F.col("genes"))).alias(c) for s, c in enumerate(SIDES)]
    return new.groupBy("id").agg(*sides).join(pop.drop(*SIDES), "id")


def start(guide: Guide, n: int, budgets: tuple[int, int], pairs: DataFrame | None = None, aligned: int = 0, purpose: str = "start") -> DataFrame:
    """(id, seeds_l1, seeds_l2): n candidates; the last ``aligned`` of them begin with reported ``pairs`` (a, b), all others and what is missing by weighted draws, then spare nodes."""
    spark = guide.facts.sparkSession
    ids = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    drawn = guide.proposals(ids, ["id", "side"], 4 * max(*budgets, 1), purpose)
    drawn = drawn.groupBy("id").agg(*[F.max(F.when(F.col("side") == s, F.col("options"))).alias(c) for s, c in enumerate(SIDES)])
    none = F.array().cast("array<bigint>")
    rows = spark.range(n).join(drawn, "id", "left").select("id", *[F.coalesce(c, none).alias(c) for c in SIDES])
    if pairs is not None and aligned:
        known = [guide.facts.filter(F.col("side") == s).select(F.col("node").alias(c)) for s, c in enumerate("ab")]
        found = evolve.matched(spark, aligned, stored(pairs.join(known[0], "a", "left_semi").join(known[1], "b", "left_semi")), min(budgets), purpose)
        found = found.select((F.col("id") + n - aligned).alias("id"), *[F.col(c).alias(f"_{c}") for c in SIDES])
        rows = rows.join(found, "id", "left").select("id", *[F.concat(F.coalesce(f"_{c}", none), c).alias(c) for c in SIDES])
    rows = rows.crossJoin(F.broadcast(guide.reserve(budgets, f"{purpose}:reserve")))
    return rows.select("id", *[repaired(F.col(c), s, budgets[s], purpose).alias(c) for s, c in enumerate(SIDES)])


def scores(pop: DataFrame, arcs1: DataFrame, arcs2: DataFrame, p: float = 0.01) -> DataFrame:
    """The candidates with t1, t2 and t3: competitive two-hop influence of either side on its layer, and their synergy, before any attack.

    All candidates meet each layer in one join of genes with arcs. Empty sides score 0. Rounded to nine places, so that ties don't depend on the order of sums.
    """
    arcs = stored(arcs1.select(F.lit(0).alias("side"), "src", "dst").unionByName(arcs2.select(F.lit(1).alias("side"), "src", "dst")))
    deg = arcs.groupBy("side", F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    genes = stored(pop.select("id", F.posexplode(F.array(*SIDES)).alias("side", "list")).select("id", "side", F.explode("list").alias("node")).distinct())
    rivals = genes.select("id", (1 - F.col("side")).alias("side"), "node")
    hop = genes.withColumnRenamed("node", "src").join(arcs, ["side", "src"]).withColumnRenamed("dst", "node")
    met = rivals.withColumnRenamed("node", "src").join(arcs, ["side", "src"]).groupBy("id", "side", F.col("dst").alias("node")).agg(F.count("*").alias("m"))
    rows = hop.join(deg, ["side", "node"]).join(met, ["id", "side", "node"], "left").join(rivals.withColumn("rival", F.lit(1)), ["id", "side", "node"], "left").join(genes.withColumn("mine", F.lit(1)), ["id", "side", "node"], "left")
    m, d = F.coalesce("m", F.lit(0)), F.col("deg")
    free = F.when(F.col("rival").isNull(), p * (1.0 + p * (d - m)) - F.when(F.col("mine") == 1, p * (1.0 + p * F.floor(d / F.pow(F.lit(2.0), m)))).otherwise(0.0)).otherwise(0.0)
    alone = F.when(F.col("mine").isNull(), p * (1.0 + p * d)).otherwise(0.0)
    sums = rows.groupBy("id", "side").agg(F.sum(free).alias("met"), F.sum(alone).alias("alone"))
    sums = genes.groupBy("id", "side").agg(F.count("*").alias("k")).join(sums, ["id", "side"], "left")
    sums = sums.select("id", "side", (F.col("k") + F.coalesce("met", F.lit(0.0))).alias("t"), (F.col("k") + F.coalesce("alone", F.lit(0.0))).alias("alone"))

    far = hop.withColumnRenamed("src", "s").withColumnRenamed("node", "src").join(arcs, ["side", "src"]).filter("dst <> s")
    paths = hop.select("id", "side", "node", F.lit(p).alias("x")).unionByName(far.select("id", "side", F.col("dst").alias("node"), F.lit(p * p).alias("x"))).unionByName(genes.withColumn("x", F.lit(1.0)))
    prob = paths.groupBy("id", "side", "node").agg(F.least(F.lit(1.0), F.sum("x")).alias("prob"))
    either = [F.max(F.when(F.col("side") == s, F.col("prob")).otherwise(0.0)) for s in (0, 1)]
    joint = prob.groupBy("id", "node").agg((1.0 - (1.0 - either[0]) * (1.0 - either[1])).alias("q")).groupBy("id").agg(F.sum("q").alias("joint"))

    of = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0))
    both = sums.groupBy("id").agg(of("t", 0).alias("t1"), of("t", 1).alias("t2"), F.sum("alone").alias("alone")).join(joint, "id", "left")
    out = pop.join(both, "id", "left").fillna(0.0, ["t1", "t2", "alone", "joint"])
    t1, t2 = F.col("t1"), F.col("t2")
    t3 = F.col("joint") / (F.col("alone") + 1e-12) * 2.0 * t1 * t2 / (t1 + t2 + 1e-12)
    return out.select(*pop.columns, F.round(t1, 9).alias("t1"), F.round(t2, 9).alias("t2"), F.round(t3, 9).alias("t3"))


def ranked(pop: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, seeds_l1, seeds_l2, mode, t1, t2, t3, skill, fitness), written: scored by ``evaluate``, which adds the three tasks."""
    rows = ranking.skill_factors(evaluate(pop), evolve.TASKS)
    return stored(rows.select("id", *SIDES, "mode", *evolve.TASKS, "skill", "fitness"))


def generation(pop: DataFrame, guide: Guide, evaluate: Callable[[DataFrame], DataFrame], size: int, budgets: tuple[int, int], rates: Rates, purpose: str, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(survivors, offspring) of a ranked population: pairs, crossing, mutation, ranks of the offspring, one survival pool."""
    pairs = parents(pop, -(-size // 2), rates.across, f"{purpose}:parents")
    made = stored(children(pop, pairs, guide, budgets, rates, f"{purpose}:cross", first_id).filter(F.col("id") < first_id + size))
    young = ranked(mutated(made, guide, rates, f"{purpose}:mutate"), evaluate)
    cost = F.when(F.col("skill") == 1, F.col("t1")).when(F.col("skill") == 2, F.col("t2")).otherwise(F.col("t3"))
    stay = ranking.survival(pop.unionByName(young).withColumn("cost", cost), size).drop("tier", "pos", "cost")
    return stored(stay), young


def search(guide: Guide, evaluate: Callable[[DataFrame], DataFrame], begin: DataFrame, size: int, budgets: tuple[int, int], generations: int, rates: Rates = Rates(), purpose: str = "search") -> tuple[DataFrame, DataFrame]:
    """(history, population): of each generation the best of each task so far, mean fitness, and how many offspring came by each mode; and who is left at the end."""
    pop = ranked(begin.withColumn("mode", F.lit("start")), evaluate)
    seen = pop.withColumn("gen", F.lit(0))
    means = pop.agg(F.lit(0).alias("gen"), F.avg("fitness").alias("mean_fitness"))
    for g in range(1, generations + 1):
        pop, young = generation(pop, guide, evaluate, size, budgets, rates, f"{purpose}:{g}", size * g)
        seen = seen.unionByName(young.withColumn("gen", F.lit(g)))
        means = means.unionByName(pop.agg(F.lit(g).alias("gen"), F.avg("fitness").alias("mean_fitness")))
    counts = [F.count(F.when(F.col("mode") == m, 1)).alias(m) for m in ("copy", "swap", "guided")]
    by = seen.groupBy("gen").agg(*[F.max(t).alias(t) for t in evolve.TASKS], *counts)
    sofar = Window.orderBy("gen")  # a row a generation
    best = [F.max(t).over(sofar).alias(f"best_{t}") for t in evolve.TASKS]
    return by.join(means, "gen").select("gen", *best, "mean_fitness", "copy", "swap", "guided"), pop
