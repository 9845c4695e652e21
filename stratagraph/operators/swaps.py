"""Local search by exchanges, over all candidates, with coverage kept as counts.

A layer's performance is the value of all that its seeds' zones cover.  For each
covered member the number of seeds that cover it and the sum of their ids are
kept, so that a member with one seed names it.  An exchange then changes the
performance by what the new zone covers freshly, less what the old seed alone
held, plus what of that the new zone holds too: the last part is a sparse table,
the others are one number a node.  After an exchange only the two zones' members
change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Digits by which candidates are compared, so that sums taken in another order choose alike.
DIGITS = 9
#: Best singles of a pair of seeds that are measured for a bound, and nodes whose zones are picked out by broadcast.
TRIED = 300
SENT = 100_000


@dataclass
class Side:
    """One layer: ``zones(src, dst)``, what each node is worth, what each zone is worth in all, and the seeds."""

    zones: DataFrame
    values: DataFrame
    totals: DataFrame
    seeds: list[int]
    cover: DataFrame
    pool: DataFrame

    @classmethod
    def of(cls, zones: DataFrame, values: DataFrame, seeds: DataFrame, pool: DataFrame | None = None) -> Side:
        """``seeds(node)`` is a budget's few rows; candidates are ``pool(node)``, or all nodes."""
        zones = stored(zones.select("src", "dst").distinct())
        values = stored(values.select("node", "value"))
        worth = zones.join(values.withColumnRenamed("node", "dst"), "dst")
        totals = stored(worth.groupBy(F.col("src").alias("node")).agg(F.sum("value").alias("total")))
        ids = sorted(r["node"] for r in seeds.select("node").distinct().collect())
        spark = zones.sparkSession
        held = zones.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "src bigint")), "src")
        cover = stored(held.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.sum("src").alias("who")))
        candidates = values.select("node") if pool is None else pool.select("node").distinct()
        return cls(zones, values, totals, ids, cover, candidates)

    def performance(self) -> float:
        return self.cover.join(self.values, "node").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("p")).collect()[0]["p"]

    def _ids(self, name: str) -> DataFrame:
        return F.broadcast(self.zones.sparkSession.createDataFrame([(i,) for i in self.seeds], f"{name} bigint"))

    def exchanges(self) -> DataFrame:
        """(out_node, in_node, delta): the best candidate for each seed (smaller ids first among equals)."""
        worth = self.cover.join(self.values, "node")
        alone = worth.filter("n = 1").groupBy(F.col("who").alias("out_node")).agg(F.sum("value").alias("alone"))
        near = worth.join(self.zones.select(F.col("dst").alias("node"), F.col("src").alias("in_node")), "node")
        near = stored(near.select("in_node", "n", "who", "value"))
        covered = near.groupBy(F.col("in_node").alias("node")).agg(F.sum("value").alias("covered"))
        free = self.pool.join(self._ids("node"), "node", "left_anti").join(self.totals, "node").join(covered, "node", "left")
        fresh = stored(free.select(F.col("node").alias("in_node"), (F.col("total") - F.coalesce("covered", F.lit(0.0))).alias("fresh")))
        shared = near.filter("n = 1").groupBy("in_node", F.col("who").alias("out_node")).agg(F.sum("value").alias("shared"))
        some = fresh.join(shared, "in_node").select("out_node", "in_node", (F.col("fresh") + F.col("shared")).alias("gain"))
        # a candidate that shares nothing with a seed counts by its fresh part: the best of all will do
        top = fresh.orderBy(F.round("fresh", DIGITS).desc(), "in_node").limit(1)
        rest = self._ids("out_node").crossJoin(F.broadcast(top)).select("out_node", "in_node", F.col("fresh").alias("gain"))
        key = F.struct(F.round("gain", DIGITS).alias("gain"), (-F.col("in_node")).alias("least"))
        best = some.unionByName(rest).groupBy("out_node").agg(F.max_by(F.struct("in_node", "gain"), key).alias("b"))
        return best.join(alone, "out_node", "left").select("out_node", "b.in_node", (F.col("b.gain") - F.coalesce("alone", F.lit(0.0))).alias("delta"))

    def exchange(self, out_node: int, in_node: int) -> None:
        """Counts change by the two zones."""
        spark = self.zones.sparkSession
        moved = F.broadcast(spark.createDataFrame([(out_node, -1), (in_node, 1)], "src bigint, by bigint"))
        change = self.zones.join(moved, "src").select(F.col("dst").alias("node"), F.col("by").alias("n"), (F.col("by") * F.col("src")).alias("who"))
        self.cover = stored(self.cover.unionByName(change).groupBy("node").agg(F.sum("n").alias("n"), F.sum("who").alias("who")).filter("n > 0"))
        self.seeds = sorted([s for s in self.seeds if s != out_node] + [in_node])


def fitness(one: float, two: float, weight: float) -> float:
    return one + two - weight * abs(one - two)


def _best(sides: list[Side]) -> list[tuple[int, int, int, float]]:
    """Each side's best exchange (side, out, in, delta); the fitness rises with either performance, so no other can be better."""
    rows = None
    for k, side in enumerate(sides):
        one = side.exchanges().orderBy(F.round("delta", DIGITS).desc(), "out_node", "in_node").limit(1)
        one = one.select(F.lit(k).alias("side"), "out_node", "in_node", "delta")
        rows = one if rows is None else rows.unionByName(one)
    return sorted((r["side"], r["out_node"], r["in_node"], r["delta"]) for r in rows.collect())


def fill_gaps(one: Side, two: Side, weight: float = 0.5, least: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """(step, layer, out_node, in_node, p1, p2, fitness): the best exchange on either layer, again and again until none adds ``least``.

    Step 0 is the beginning.  ``weight`` is at most 1, so that more performance
    never lowers the fitness.  ``rounds`` may end the search earlier.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight lies between 0 and 1")
    sides = [one, two]
    p = [one.performance(), two.performance()]
    rows = [(0, None, None, None, *p, fitness(*p, weight))]
    while rounds is None or len(rows) <= rounds:
        tried = []
        for k, out_node, in_node, delta in _best(sides):
            then = [p[0] + delta, p[1]] if k == 0 else [p[0], p[1] + delta]
            tried.append((round(fitness(*then, weight) - fitness(*p, weight), DIGITS), -k, out_node, in_node, then))
        if not tried or max(tried)[0] <= least:
            break
        _, k, out_node, in_node, p = max(tried)
        sides[-k].exchange(out_node, in_node)
        rows.append((len(rows), 1 - k, out_node, in_node, *p, fitness(*p, weight)))
    return one.zones.sparkSession.createDataFrame(rows, "step int, layer int, out_node bigint, in_node bigint, p1 double, p2 double, fitness double")


def two_swap_across(one: Side, two: Side, weight: float = 0.5) -> DataFrame:
    """(out_l1, in_l1, out_l2, in_l2, fitness): the best pair of one exchange a layer, over all pairs of candidates.

    The fitness rises with either performance, so the pair is made of both layers' best.
    """
    p = [one.performance(), two.performance()]
    found = {k: r for k, *r in _best([one, two])}
    rows = []
    if len(found) == 2:
        (a, b, x), (c, d, y) = found[0], found[1]
        rows = [(a, b, c, d, fitness(p[0] + x, p[1] + y, weight))]
    return one.zones.sparkSession.createDataFrame(rows, "out_l1 bigint, in_l1 bigint, out_l2 bigint, in_l2 bigint, fitness double")


def two_swap_within(side: Side) -> DataFrame:
    """(out_a, out_b, in_a, in_b, delta): the best exchange of two seeds for two nodes on one layer, over all pairs.

    A pair adds its two singles less the overlap of their zones, a sparse table.
    What a pair that doesn't overlap adds is known from singles alone, so a
    node whose single, with the best one, can't come up to a pair already
    measured is left out before overlaps are formed.  A single differs from
    what its node adds freshly only where the two seeds free some of its zone:
    those are a sparse table, so that no node has a row for every two seeds.
    """
    spark = side.zones.sparkSession
    shape = "out_a bigint, out_b bigint, in_a bigint, in_b bigint, delta double"
    pairs = [(a, b) for i, a in enumerate(side.seeds) for b in side.seeds[i + 1 :]]
    if not pairs:
        return spark.createDataFrame([], shape)
    outs = F.broadcast(spark.createDataFrame(pairs, "out_a bigint, out_b bigint"))  # the budget's pairs
    held = side.zones.join(F.broadcast(spark.createDataFrame([(i,) for i in side.seeds], "src bigint")), "src")
    cover = stored(held.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("by")).join(side.values, "node"))
    # members that the two seeds alone hold: free once both are gone
    within = cover.filter(F.size("by") <= 2).join(outs, F.expr("forall(by, s -> s = out_a or s = out_b)"))
    freed = stored(within.select("out_a", "out_b", "node", "value"))
    loss = freed.groupBy("out_a", "out_b").agg(F.sum("value").alias("loss"))
    loss = outs.join(loss, ["out_a", "out_b"], "left").select("out_a", "out_b", F.coalesce("loss", F.lit(0.0)).alias("loss"))
    near = side.zones.select(F.col("dst").alias("node"), F.col("src").alias("in_node"))
    covered = cover.join(near, "node").groupBy("in_node").agg(F.sum("value").alias("covered"))
    free = side.pool.join(side._ids("node"), "node", "left_anti").join(side.totals, "node").withColumnRenamed("node", "in_node").join(covered, "in_node", "left")
    fresh = stored(free.select("in_node", (F.col("total") - F.coalesce("covered", F.lit(0.0))).alias("fresh")))
    again = freed.join(near, "node").groupBy("out_a", "out_b", "in_node").agg(F.sum("value").alias("again"))
    pair = ["out_a", "out_b"]
    touched = stored(fresh.join(again, "in_node").select(*pair, "in_node", (F.col("fresh") + F.col("again")).alias("single")))
    # values are 0 or more, so that of a node's two rows the larger is its single
    single = lambda rows: rows.groupBy(*pair, "in_node").agg(F.max("single").alias("single"))
    most = fresh.orderBy(F.desc("fresh"), "in_node").limit(TRIED).select("in_node", F.col("fresh").alias("single"))
    tried = single(touched.unionByName(outs.crossJoin(most))).withColumn("_r", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("single"), "in_node")))
    tried = stored(tried.filter(F.col("_r") <= TRIED))

    def measured(found: DataFrame) -> DataFrame:
        """(out_a, out_b, in_a, in_b, delta) of pairs with both singles: overlaps are taken off."""
        uncovered = side.values.join(cover.select("node"), "node", "left_anti")
        wanted = found.select("in_a", "in_b").distinct()
        ends = stored(wanted.select(F.explode(F.array("in_a", "in_b")).alias("in_node")).distinct())
        theirs = stored(near.join(F.broadcast(ends) if ends.count() <= SENT else ends.hint("merge"), "in_node", "left_semi").select("node", "in_node"))
        a, b = theirs.toDF("node", "in_a"), theirs.toDF("node", "in_b")
        both = wanted.join(a, "in_a").join(b, ["node", "in_b"])
        fresh_part = both.join(uncovered, "node").groupBy("in_a", "in_b").agg(F.sum("value").alias("over"))
        freed_part = found.join(a, "in_a").join(b, ["node", "in_b"]).join(freed, ["out_a", "out_b", "node"]).groupBy("out_a", "out_b", "in_a", "in_b").agg(F.sum("value").alias("over_freed"))
        out = found.join(fresh_part, ["in_a", "in_b"], "left").join(freed_part, ["out_a", "out_b", "in_a", "in_b"], "left")
        delta = F.col("x") + F.col("y") - F.coalesce("over", F.lit(0.0)) - F.coalesce("over_freed", F.lit(0.0)) - F.col("loss")
        return out.join(loss, ["out_a", "out_b"]).select("out_a", "out_b", "in_a", "in_b", delta.alias("delta"))

    def ordered(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b, ["out_a", "out_b"]).filter("p <> q").distinct()
        flip = F.col("p") > F.col("q")
        return both.select("out_a", "out_b", F.least("p", "q").alias("in_a"), F.greatest("p", "q").alias("in_b"), F.when(flip, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(flip, F.col("x")).otherwise(F.col("y")).alias("y")).distinct()

    right = tried.select(*pair, F.col("in_node").alias("q"), F.col("single").alias("y"))
    tops = tried.filter("_r = 1").select(*pair, F.col("in_node").alias("p"), F.col("single").alias("x"))
    order = [F.round("delta", DIGITS).desc(), "out_a", "out_b", "in_a", "in_b"]
    # the best single with the next ones: a bound that is itself a pair
    bound = measured(stored(ordered(tops, right))).agg(F.max("delta").alias("d")).collect()[0]["d"]
    if bound is None:
        return spark.createDataFrame([], shape)
    reach = F.broadcast(stored(tops.join(loss, pair).select(*pair, F.col("x").alias("most"), "loss")))  # the budget's pairs
    enough = F.col("single") + F.col("most") - F.col("loss") >= bound - 1e-9
    again_live = touched.join(reach, pair).filter(enough).select(*pair, "in_node", "single")
    fresh_live = fresh.withColumnRenamed("fresh", "single").join(reach).filter(enough).select(*pair, "in_node", "single")
    live = stored(single(again_live.unionByName(fresh_live)).join(reach, pair).select(*pair, "in_node", "single", "loss"))
    a = live.select("out_a", "out_b", F.col("in_node").alias("p"), F.col("single").alias("x"), "loss")
    b = live.select("out_a", "out_b", F.col("in_node").alias("q"), F.col("single").alias("y"))
    ahead = a.join(b, ["out_a", "out_b"]).filter((F.col("p") < F.col("q")) & (F.col("x") + F.col("y") - F.col("loss") >= bound - 1e-9))
    found = stored(ahead.select("out_a", "out_b", F.col("p").alias("in_a"), F.col("q").alias("in_b"), "x", "y"))
    best = measured(found).orderBy(*order).limit(1)
    return best.select("out_a", "out_b", "in_a", "in_b", "delta")
