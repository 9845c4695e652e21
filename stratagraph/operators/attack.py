"""Attacks of any length on a layer that stays a table.

Scores never rise while nodes are removed, so the best score outside a short list
of candidates bounds all other nodes. For the list, two small tables tell what a
removal takes from whom: who is whose neighbour, and how many counted neighbours
two candidates share. The order of removals is followed exactly from these
numbers until the bound is met; then the next list is made. A round costs a few
jobs, whatever the number of steps it yields.

More steps than a list holds go by contests: a node that is best of all within two
arcs keeps its score until its turn comes, so all such nodes go in one round, and
the order of removals is that of the scores they went with. Only nodes that may still
come down to a lowest score take part, with their arcs; then the next lowest is set. Rounds
follow the longest chain of nodes that wait for one another, not the number of steps. What seeds reach
at every step then follows from how long each node lived, in one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import ranking
from .influence import activation, rescaled, two_hop

#: Candidates of a round; its square bounds what the driver holds.
WIDTH = 256
#: Nodes by which a contest is larger than what is still to be removed, and nodes that all go to one contest.
CONTEST, FEW = 2.0, 1 << 15


def _marked(a: DataFrame, b: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, dst, counts): whether the attacker counts the neighbour; a seed doesn't count the other side's, other nodes neither side's."""
    sides = a.select("node", F.lit(1).alias("s")).union(b.select("node", F.lit(2).alias("s"))).groupBy("node").agg(F.bit_or("s").alias("s"))
    rows = arcs.select("src", "dst").join(sides.toDF("src", "own"), "src", "left").join(sides.toDF("dst", "its"), "dst", "left")
    own, its = F.coalesce("own", F.lit(0)), F.coalesce("its", F.lit(0))
    block = F.when(own.bitwiseAND(F.lit(1)) > 0, 2).when(own == 2, 1).otherwise(3)
    return rows.select("src", "dst", (its.bitwiseAND(block) == 0).alias("counts"))


def _followed(top: list, near: list, shared: list, steps: int, width: int) -> list[int]:
    """The removals that a list of (node, score, deg) decides; its last row beyond ``width`` is the bound."""
    bound = (top[width]["score"], -top[width]["node"]) if len(top) > width else (0, -np.inf)
    node = np.array([r["node"] for r in top[:width]])
    score, deg = (np.array([r[c] for r in top[:width]], np.int64) for c in ("score", "deg"))
    at = {v: i for i, v in enumerate(node.tolist())}
    n = len(node)
    touch, counts, common = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    for r in near:
        touch[at[r["src"]], at[r["dst"]]] = 1
        counts[at[r["src"]], at[r["dst"]]] = int(r["counts"])
    for r in shared:
        common[at[r["c"]], at[r["v"]]] = r["n"]
    gone = np.zeros(n, np.int64)
    out: list[int] = []
    while len(out) < steps and not gone.all():
        # a removed neighbour is missing with what it is worth by now; any other lacks its removed neighbours
        now = score - common @ gone - counts @ (gone * (1 + deg - touch @ gone))
        now[gone == 1] = -1
        i = max(range(n), key=lambda j: (now[j], -node[j]))
        if (now[i], -node[i]) <= bound or now[i] <= 0:
            break
        gone[i] = 1
        out.append(int(node[i]))
    return out


def _contest(arcs: DataFrame, span: int, most: int, least: int) -> DataFrame:
    """(node, key, wins): score and place in one number of every node that scores ``least`` or more, and whether none of them within two arcs has a larger one."""
    score = arcs.groupBy("src").agg(F.sum(F.when(F.col("counts"), 1 + F.col("deg")).otherwise(0)).alias("score"))
    own = score.filter(F.col("score") >= least).select("src", (F.col("score") * F.lit(span) + (F.lit(most) - F.col("src"))).alias("key"))
    rows = arcs.select("src", "dst").join(own, "src")
    near = rows.select("dst", "key").unionByName(own.select(F.col("src").alias("dst"), "key")).groupBy("dst").agg(F.max("key").alias("near"))
    met = rows.join(near, "dst").groupBy(F.col("src").alias("node")).agg(F.max("key").alias("key"), F.max("near").alias("near"))
    return met.select("node", "key", (F.col("key") >= F.col("near")).alias("wins"))


def _without(arcs: DataFrame, gone: DataFrame, taken: DataFrame) -> DataFrame:
    """The arcs without the nodes ``gone(node)``, whose arcs ``taken(src, dst)`` hold; the neighbours' degrees fall."""
    lost = taken.join(gone.select(F.col("node").alias("src")), "src").select("dst", F.lit(1).alias("lost"), F.lit(0).alias("dead"))
    change = lost.unionByName(gone.select(F.col("node").alias("dst"), F.lit(0).alias("lost"), F.lit(1).alias("dead")))
    change = change.groupBy("dst").agg(F.sum("lost").alias("lost"), F.max("dead").alias("dead"))
    rest = arcs.join(change, "dst", "left").filter(F.coalesce("dead", F.lit(0)) == 0)
    return rest.select("src", "dst", "counts", (F.col("deg") - F.coalesce("lost", F.lit(0))).alias("deg"))


def _by_contests(live: DataFrame, steps: int) -> DataFrame:
    """(node, score) of removed nodes, the first ``steps`` in order of score among them, or all that ever have a score."""
    deg = live.groupBy("dst").agg(F.count("*").alias("deg"))
    live = stored(live.join(deg, "dst").select("src", "dst", "counts", "deg"))
    least, most, top = live.groupBy("src").agg(F.sum(1 + F.col("deg")).alias("score")).agg(F.min("src"), F.max("src"), F.max("score")).collect()[0]
    if least is None:
        return live.select(F.col("src").alias("node"), F.col("deg").alias("score"))
    span = most - least + 1
    if span * (top + 1) >= 1 << 62:  # ids too far apart to stand in a number beside a score: their places do
        names = stored(ranking.running(live.select(F.col("src").alias("id")).distinct(), [F.asc("id")], place=F.lit(1).cast("bigint")))
        named = live.join(names.toDF("src", "p"), "src").join(names.toDF("dst", "q"), "dst").select(F.col("p").alias("src"), F.col("q").alias("dst"), "counts")
        return _by_contests(named, steps).join(names.toDF("node", "place").withColumnsRenamed({"node": "id", "place": "node"}), "node").select(F.col("id").alias("node"), "score")
    gone, n = None, 0
    while n < steps:
        # all that go with ``low`` or more go before any other, and only their arcs are needed for it
        score = live.groupBy("src").agg(F.sum(F.when(F.col("counts"), 1 + F.col("deg")).otherwise(0)).alias("score")).filter("score > 0")
        size = score.count()
        if not size:
            break
        share = CONTEST * (steps - n) / size
        low = 1 if share >= 1 or size <= FEW else score.agg(F.percentile_approx("score", 1.0 - share, 10_000)).collect()[0][0]
        arcs = live if low == 1 else stored(live.join(score.filter(F.col("score") >= low).select("src"), "src", "left_semi"))
        phase = None
        while True:
            found = stored(_contest(arcs, span, most, low))
            won, left = found.agg(F.count_if("wins"), F.max(F.when(~F.col("wins"), F.col("key")))).collect()[0]
            if not won:
                break
            winners = found.filter("wins").select("node", "key")
            phase, n = winners if phase is None else phase.unionByName(winners), n + won
            gone = winners if gone is None else gone.unionByName(winners)
            if left is None or n >= steps and gone.filter(F.col("key") > F.lit(left)).count() >= steps:
                break  # whoever is left has less by now, and gets no more
            others = found.filter("not wins").select(F.col("node").alias("src"))
            arcs = stored(_without(arcs.join(others, "src", "left_semi"), winners, arcs))
        if n < steps:
            live = stored(_without(live.join(phase.select(F.col("node").alias("src")), "src", "left_anti"), phase, live))
    if gone is None:
        return live.limit(0).select(F.col("src").alias("node"), F.col("deg").alias("score"))
    return gone.select("node", F.floor(F.col("key") / F.lit(span)).alias("score"))


def _many(nodes: DataFrame, live: DataFrame, steps: int) -> DataFrame:
    """(step, node) of ``removals`` by contests; the removed nodes stay a table."""
    gone = ranking.running(_by_contests(live, steps), [F.desc("score"), F.asc("node")], step=F.lit(1))
    gone = stored(gone.filter(F.col("step") <= steps).select(F.col("step").cast("int").alias("step"), "node"))
    n = gone.count()
    if n == steps:
        return gone
    least = nodes.agg(F.min("node").alias("node")).filter("node is not null").join(gone.select("node"), "node", "left_anti")
    return gone.unionByName(least.select(F.lit(n + 1).alias("step"), "node"))


def removals(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs: DataFrame, steps: int, width: int = WIDTH) -> DataFrame:
    """(step, node): at each step the node of best two-hop score goes, the smallest id among equals.

    Where no score is left, the smallest node goes if it is still there, and later
    steps remove nothing: they have no row.
    """
    if steps > width:
        return _many(nodes, _marked(a, b, arcs), steps)
    live = stored(_marked(a, b, arcs))
    gone: list[int] = []
    while len(gone) < steps:
        deg = live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("deg"))
        score = live.filter("counts").join(deg.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(1 + F.col("deg")).alias("score"))
        top = score.join(deg, "node").orderBy(F.desc("score"), "node").limit(width + 1).collect()  # a short list
        if not top:
            least = nodes.agg(F.min("node")).collect()[0][0]
            if least is not None and least not in gone:
                gone.append(least)
            break
        listed = F.broadcast(nodes.sparkSession.createDataFrame([(r["node"],) for r in top[:width]], "c bigint"))
        out = live.join(listed.withColumnRenamed("c", "src"), "src")
        near = out.join(listed.withColumnRenamed("c", "dst"), "dst").collect()
        back = live.join(listed.withColumnRenamed("c", "dst"), "dst").select(F.col("src").alias("mid"), F.col("dst").alias("v"))
        shared = out.filter("counts").select(F.col("src").alias("c"), F.col("dst").alias("mid")).join(back, "mid").groupBy("c", "v").agg(F.count("*").alias("n")).collect()
        taken = _followed(top, near, shared, steps - len(gone), width)
        gone += taken
        if len(gone) < steps:
            dead = F.broadcast(nodes.sparkSession.createDataFrame([(v,) for v in taken], "node bigint"))  # a list's length at most
            live = stored(live.join(dead.withColumnRenamed("node", "src"), "src", "left_anti").join(dead.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "counts"))
    return nodes.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(gone)], "step int, node bigint")


def mean_influence(own: DataFrame, other: DataFrame, nodes: DataFrame, arcs: DataFrame, removed: DataFrame, steps: int, p: float = 0.01, weights: DataFrame | None = None, name: str = "a") -> DataFrame:
    """(name): the mean over ``steps`` of what ``own`` reaches against ``other`` in two hops, nodes leaving at the steps of ``removed(step, node)``.

    A path counts at as many steps as its shortest-lived node saw. 0 without steps.
    """
    if steps <= 0:
        return nodes.sparkSession.createDataFrame([(0.0,)], f"{name} double")
    w = nodes.select("node", F.lit(1.0).alias("w")) if weights is None else rescaled(weights).select("node", "w")
    facts = w.join(removed, "node", "left").join(other.select("node").distinct().withColumn("rival", F.lit(1)), "node", "left")
    facts = stored(facts.select("node", "w", F.coalesce(F.col("step") - 1, F.lit(steps)).alias("life"), F.coalesce("rival", F.lit(0)).alias("rival")))
    # a row a node: far larger than its compressed file tells, so it is joined by shuffles
    of = lambda c: facts.hint("merge").select(F.col("node").alias(c), F.col("w").alias(f"w_{c}"), F.col("life").alias(f"life_{c}"), F.col("rival").alias(f"rival_{c}"))
    seeds = own.groupBy(F.col("node").alias("s")).agg(F.count("*").alias("times")).join(of("s"), "s")
    hop = seeds.join(arcs.select(F.col("src").alias("s"), F.col("dst").alias("j")), "s").join(of("j"), "j").filter("rival_j = 0")
    hop = stored(hop.select("s", "j", "times", "w_j", F.least("life_s", "life_j").alias("life")))
    far = hop.select("j", "times", "life").join(arcs.select(F.col("src").alias("j"), F.col("dst").alias("k")), "j").join(of("k"), "k").filter("rival_k = 0")

    # own seeds next to each other: halved once for every rival beside them, step by step
    inner = hop.join(own.select(F.col("node").alias("j")).distinct(), "j", "left_semi")
    around = inner.select("j").distinct().join(arcs.select(F.col("src").alias("j"), F.col("dst").alias("k")), "j").join(of("k"), "k")
    sizes = around.groupBy("j").agg(F.count("*").alias("all"), F.sum("rival_k").alias("rivals"))
    deaths = around.filter(F.col("life_k") < steps).groupBy("j", (F.col("life_k") + 1).alias("i")).agg(F.count("*").alias("d"), F.sum("rival_k").alias("dr"))
    days = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps)))).join(deaths, ["j", "i"], "left")
    upto = Window.partitionBy("j").orderBy("i")
    left, rivals = F.col("all") - F.sum(F.coalesce("d", F.lit(0))).over(upto), F.col("rivals") - F.sum(F.coalesce("dr", F.lit(0))).over(upto)
    days = days.select("j", "i", F.floor(left / F.pow(F.lit(2.0), F.least(rivals, F.lit(62)))).alias("halved"))
    met = inner.join(days, "j").filter(F.col("i") <= F.col("life"))

    parts = [
        seeds.select((F.col("times") * F.col("w_s") * steps).alias("x")),
        hop.select((F.col("times") * p * F.col("w_j") * F.col("life")).alias("x")),
        far.select((F.col("times") * p * p * F.col("w_k") * F.least("life", "life_k")).alias("x")),
        met.select((-F.col("times") * p * F.col("w_j") * (1.0 + p * F.col("halved"))).alias("x")),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.agg((F.coalesce(F.sum("x"), F.lit(0.0)) / steps).alias(name))


def robust(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs: DataFrame, p: float = 0.01, steps: int = 5, weights_a: DataFrame | None = None, weights_b: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(total, a, b): mean competitive influence over an attack of ``steps`` removals; each removes first and is measured then."""
    gone = stored(removals(a, b, nodes, arcs, steps, width))
    one = mean_influence(a, b, nodes, arcs, gone, steps, p, weights_a, "a")
    both = one.crossJoin(mean_influence(b, a, nodes, arcs, gone, steps, p, weights_b, "b"))  # a row each
    return both.select((F.col("a") + F.col("b")).alias("total"), "a", "b")


def synergy(a: DataFrame, b: DataFrame, nodes: DataFrame, arcs1: DataFrame, arcs2: DataFrame, p: float = 0.01, steps: int = 5, weights1: DataFrame | None = None, weights2: DataFrame | None = None) -> DataFrame:
    """(r1, r2, r_cr): robustness of side a on layer 1 and of side b on layer 2, and their joint score.

    Joint probability over both sides' single influences, times twice the
    harmonic mean of the robust scores.
    """
    tiny = 1e-12

    def robust_side(own: DataFrame, other: DataFrame, arcs: DataFrame, weights: DataFrame | None, name: str) -> DataFrame:
        gone = stored(removals(own, other, nodes, arcs, steps))
        return stored(mean_influence(own, other, nodes, arcs, gone, steps, p, weights, name))

    # a row each, written one after the other, so that one part's tables are held at a time
    r1 = robust_side(a, b, arcs1, weights1, "r1")
    r2 = robust_side(b, a, arcs2, weights2, "r2")
    p1 = activation(a, nodes, arcs1, p).withColumnRenamed("prob", "p1")
    p2 = activation(b, nodes, arcs2, p).withColumnRenamed("prob", "p2")
    joint = stored(p1.join(p2.hint("merge"), "node").agg(F.sum(1.0 - (1.0 - F.col("p1")) * (1.0 - F.col("p2"))).alias("joint")))
    s1 = stored(two_hop(a, nodes, arcs1, p).withColumnRenamed("influence", "s1"))
    s2 = stored(two_hop(b, nodes, arcs2, p).withColumnRenamed("influence", "s2"))
    ratio = F.col("joint") / (F.col("s1") + F.col("s2") + tiny)
    mean = 2.0 * F.col("r1") * F.col("r2") / (F.col("r1") + F.col("r2") + tiny)
    return joint.crossJoin(s1).crossJoin(s2).crossJoin(r1).crossJoin(r2).select("r1", "r2", (ratio * mean).alias("r_cr"))
