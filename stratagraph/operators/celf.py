"""Labels of all nodes in the order of the greedy cascade: what each adds when its turn comes.

Taken one after the other this would be a round a node.  But gains only fall,
so a node that stands first (highest gain, then smallest id) among all that
could still cover one of its uncovered elements keeps its gain until its turn.
All such nodes are labelled in one round; the result is that of the sequential
order.  An element is a (simulation, node) pair.  Nodes reach themselves in
every simulation, so only pairs of differing nodes are rows: the table grows
with live arcs, not with nodes times simulations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ranking import running
from .walks import live_arcs


def reach_pairs(layers: dict[int, DataFrame], p: float, sims: int, purpose: str = "ic") -> DataFrame:
    """(sim, origin, node): what each node reaches over live arcs of one layer, itself left out.

    Paths are joined to paths, so that the rounds grow with the logarithm of the
    longest.  A round forms what is more than ``span`` and at most twice ``span``
    arcs away, from pairs that lie exactly ``span`` apart; only rows of nodes
    that begin or end such a pair are read again, fewer in each round.
    """
    keys = ["layer", "sim", "origin"]
    live = live_arcs(layers, p, sims, purpose).filter("src <> dst").select("layer", "sim", F.col("src").alias("origin"), F.col("dst").alias("node")).distinct()
    base = stored(live.withColumn("far", F.lit(1)))
    found, span = [base], 1
    while True:
        ends = base.filter(F.col("far") == span).select(*keys, "node")
        on = base.select("layer", "sim", F.col("origin").alias("node"), F.col("node").alias("end"), "far")
        longer = ends.join(on, ["layer", "sim", "node"]).filter("origin <> end").groupBy(*keys, F.col("end").alias("node")).agg((F.min("far") + span).alias("far"))
        new = stored(longer.join(base.select(*keys, "node"), [*keys, "node"], "left_anti"))
        span *= 2
        at = new.filter(F.col("far") == span).select("layer", "sim", F.explode(F.array("origin", "node")).alias("origin"))
        found.append(new)
        if at.isEmpty():
            return stored(reduce(DataFrame.unionByName, found).select("sim", "origin", "node").distinct())
        base = stored(base.unionByName(new).join(at.distinct(), keys, "left_semi"))


def labels(nodes: DataFrame, layers: dict[int, DataFrame], p: float, sims: int, purpose: str = "ic") -> DataFrame:
    """(node, label, pos): the mean number of nodes that each adds, and its place in the greedy order from 1.

    Each round writes what is left; rounds follow the longest chain of nodes
    that wait for one another, not the number of nodes.  A node taken stands
    first at all its elements, so that an element is covered if and only if the
    one that stands first there is taken.
    """
    left = reach_pairs(layers, p, sims, purpose)
    own = nodes.select("node", F.lit(sims).cast("bigint").alias("own")).distinct()
    element = Window.partitionBy("node", "sim")
    done: DataFrame | None = None
    while True:
        more = left.groupBy(F.col("origin").alias("node")).agg(F.count("*").alias("more"))
        gains = stored(own.join(more, "node", "left").select("node", "own", (F.col("own") + F.coalesce("more", F.lit(0))).alias("gain")))
        if gains.isEmpty():
            break
        rows = left.join(gains.select(F.col("node").alias("origin"), F.col("gain").alias("by")), "origin")
        rows = rows.join(gains.select("node", "gain"), "node")
        # the rows of a node lie together after the join, its elements too
        best = F.greatest(F.max(F.struct(F.col("by").alias("gain"), (-F.col("origin")).alias("least"))).over(element), F.struct("gain", (-F.col("node")).alias("least")))
        rows = stored(rows.select("sim", "origin", "node", (-best["least"]).alias("first"), (F.col("origin") == F.max("origin").over(element)).alias("one")))
        behind = rows.filter("origin <> first").select(F.col("origin").alias("node")).union(rows.filter("one and node <> first").select("node")).distinct()
        taken = stored(gains.join(behind, "node", "left_anti").select("node", "gain"))
        done = taken if done is None else done.unionByName(taken)
        firsts = taken.select(F.col("node").alias("first"))
        lost = rows.filter("one").join(firsts, "first", "left_semi").groupBy("node").agg(F.count("*").alias("lost"))
        own = gains.join(taken, "node", "left_anti").join(lost, "node", "left").select("node", (F.col("own") - F.coalesce("lost", F.lit(0))).alias("own"))
        left = stored(rows.join(firsts, "first", "left_anti").select("sim", "origin", "node"))
    if done is None:
        return nodes.select("node", F.lit(0.0).alias("label"), F.lit(0).cast("bigint").alias("pos"))
    placed = running(done, [F.desc("gain"), F.asc("node")], pos=F.lit(1).cast("bigint"))
    return placed.select("node", (F.col("gain") / F.lit(float(sims))).alias("label"), "pos")
