"""Node features of a layer."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from . import graph, krylov
from .components import components
from .ranking import ordinal

#: Nodes of a small component; sources of one breadth-first search at most, each node holding a bit for each, HELD bits in all where the component is large.
SOURCES, WIDTH, HELD = 1024, 2048, 1 << 31
#: Sources of a task, more where there would be over MAX_SHARES shares: a share holds the arcs of its component.
SHARE, MAX_SHARES = 16_384, 64
#: Neighbours that a search takes one by one, the j-th of all nodes together; those of hubs beyond them come in stretches.
SLOTS, STRETCH = 32, 1 << 16
#: Nodes that a search takes at a time, so that what it writes stays in the cache.
ROWS = 2048
#: A level looks for the neighbours of the nodes that gained a source where these are fewer than one in FEW.
FEW = 8


def _neighbour_degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, deg, nbr, nbr_deg) for each arc."""
    deg = graph.degree(nodes, arcs)
    own = arcs.join(deg.withColumnRenamed("node", "src"), "src")
    return own.join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("nbr_deg")), "dst").select(F.col("src").alias("node"), "deg", F.col("dst").alias("nbr"), "nbr_deg")


def _all(nodes: DataFrame, values: DataFrame, name: str, default) -> DataFrame:
    return nodes.join(values, "node", "left").select("node", F.coalesce(name, F.lit(default)).alias(name))


def _h_of(values: DataFrame, value: str, name: str) -> DataFrame:
    """Per node the largest h such that h of its values are h or more."""
    w = Window.partitionBy("node").orderBy(F.desc(value))
    ranked = values.select("node", value, F.row_number().over(w).alias("rn"))
    return ranked.groupBy("node").agg(F.max(F.when(F.col(value) >= F.col("rn"), F.col("rn")).otherwise(0)).cast("bigint").alias(name))


def h_index(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    return _all(nodes, _h_of(_neighbour_degrees(nodes, arcs), "nbr_deg", "h_index"), "h_index", 0)


def core_numbers(nodes: DataFrame, arcs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, core): degrees, then the h-index of the neighbours' values until no value changes, which is the core number.

    With ``rounds``, so many rounds only: upper bounds of the core numbers.
    """
    value = graph.degree(nodes, arcs).withColumnRenamed("deg", "core")

    def following(value: DataFrame) -> DataFrame:
        around = arcs.join(value.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "core")
        return _all(nodes, _h_of(around, "core", "core"), "core", 0)

    if rounds is not None:
        for _ in range(rounds):
            value = following(value)
        return value
    arcs = stored(arcs)
    total = None
    while True:  # values only fall, so an equal sum means that none changed
        value = stored(value)
        last, total = total, value.agg(F.sum("core")).collect()[0][0]
        if total == last:
            return value
        value = following(value)


def average_neighbour_degree(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    return _all(nodes, _neighbour_degrees(nodes, arcs).groupBy("node").agg(F.avg("nbr_deg").alias("avg_nbr_deg")), "avg_nbr_deg", 0.0)


def spreading_index(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """Mean over neighbours of the hypotenuse of both degrees."""
    each = F.sqrt(F.pow("deg", F.lit(2.0)) + F.pow("nbr_deg", F.lit(2.0)))
    return _all(nodes, _neighbour_degrees(nodes, arcs).groupBy("node").agg(F.avg(each).alias("si")), "si", 0.0)


def influence_power(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """deg + 2 / (cc + 1) * sum of neighbours' deg / (cc + 1); 0 for isolated nodes."""
    cc = graph.clustering(nodes, edges)
    arcs = graph.symmetric(edges)
    share = arcs.join(cc.select(F.col("node").alias("dst"), (F.col("deg") / (F.col("cc") + 1.0)).alias("x")), "dst")
    share = share.groupBy(F.col("src").alias("node")).agg(F.sum("x").alias("x"))
    out = F.col("deg") + 2.0 / (F.col("cc") + 1.0) * F.col("x")
    return cc.join(share, "node", "left").select("node", F.coalesce(out, F.lit(0.0)).alias("nip"))


def degree_centrality(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    return graph.degree(nodes, arcs).crossJoin(n).select("node", (F.col("deg") / F.nullif(F.col("n") - 1, F.lit(0))).alias("degree_centrality"))


def robustness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, score): half coverage, 0.3 clustering, 0.2 degree share; 0 for isolated nodes; sums to 1."""
    n = nodes.agg(F.count("*").alias("n"))
    rows = graph.clustering(nodes, edges).join(graph.coverage(nodes, graph.symmetric(edges)), "node").crossJoin(n)
    raw = F.when(F.col("deg") == 0, 0.0).otherwise(0.5 * F.col("coverage") / F.col("n") + 0.3 * F.col("cc") + 0.2 * F.col("deg") / F.col("n"))
    rows = rows.select("node", raw.alias("raw"))
    total = rows.agg(F.sum("raw").alias("total"))
    return rows.crossJoin(total).select("node", (F.col("raw") / F.nullif("total", F.lit(0.0))).alias("score"))


def pagerank(nodes: DataFrame, arcs: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """(node, rank), iterated until all ranks together move less than ``tolerance`` a node; dangling mass is spread evenly.

    Arcs are dealt by their source once; each round writes its ranks, and the
    dangling mass is a number of the round.
    """
    nodes = stored(nodes.select("node"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    deg = graph.degree(nodes, arcs).withColumnRenamed("node", "src")
    out = arcs.join(deg.filter("deg > 0"), "src").select("src", "dst", (1.0 / F.col("deg")).alias("share"), F.lit(None).cast("boolean").alias("loose"))
    own = deg.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("share"), (F.col("deg") == 0).alias("loose"))
    links = stored(out.unionByName(own).repartition("src"))
    rank = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    loose = links.filter("loose").count() / n
    for _ in range(rounds):
        sent = links.join(rank.select(F.col("node").alias("src"), "rank"), "src")
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"), F.max(F.when(F.col("loose").isNotNull(), F.col("rank"))).alias("before"), F.max("loose").alias("loose"))
        rank = stored(got.select("node", (F.lit((1.0 - damping) / n) + F.lit(damping) * (F.col("got") + F.lit(loose / n))).alias("rank"), "before", "loose"))
        moved, loose = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), F.sum(F.when(F.col("loose"), F.col("rank")).otherwise(0.0))).collect()[0]
        if moved < n * tolerance:
            break
    return rank.select("node", "rank")


def multilayer_rank(nodes: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(node, rank, pos): page ranks summed over layers to nine places, best first, smaller ids among equals."""
    each = reduce(DataFrame.unionByName, [pagerank(nodes, arcs) for arcs in layers])
    rows = each.groupBy(F.col("node").alias("id")).agg(F.round(F.sum("rank"), 9).alias("rank"))
    return ordinal(rows, "rank", "pos").withColumnRenamed("id", "node")


def eigenvector(nodes: DataFrame, arcs: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, eigen): power iteration from equal weights, of unit length; each round writes its values."""
    arcs = stored(arcs.repartition("dst"))
    state, size = nodes.select("node", F.lit(1.0).alias("x")), 1.0
    for _ in range(rounds):
        got = arcs.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.sum("x") / F.lit(size)).alias("x"))
        state = stored(_all(nodes, got, "x", 0.0))
        size = state.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).collect()[0][0] or 1.0
    return state.select("node", (F.col("x") / F.lit(size)).alias("eigen"))


def weighted_robustness(nodes: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, score): half coverage, 0.3 clustering and 0.2 degree over n - 1, times the weight; sums to 1, even shares where all are 0."""
    n = nodes.agg(F.count("*").alias("n"))
    rows = graph.clustering(nodes, edges).join(graph.coverage(nodes, graph.symmetric(edges)), "node").join(weights, "node").crossJoin(n)
    raw = 0.5 * F.col("coverage") / F.col("n") + 0.3 * F.col("cc") + 0.2 * F.col("deg") / F.greatest(F.col("n") - 1, F.lit(1))
    rows = rows.select("node", "n", (raw * F.col("w")).alias("raw"))
    all_of = rows.agg(F.sum("raw").alias("all"))
    return rows.crossJoin(all_of).select("node", F.when(F.col("all") > 0, F.col("raw") / F.col("all")).otherwise(1.0 / F.col("n")).alias("score"))


def distances(arcs: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(src, node, dist) of all nodes within ``depth`` arcs of the sources (bounded: one join a level)."""
    seen = sources.select(F.col("node").alias("src"), "node", F.lit(0).alias("dist"))
    front = seen
    for d in range(1, depth + 1):
        step = front.select("src", F.col("node").alias("mid")).join(arcs.select(F.col("src").alias("mid"), F.col("dst").alias("node")), "mid")
        front = step.select("src", "node").distinct().join(seen.select("src", "node"), ["src", "node"], "left_anti").select("src", "node", F.lit(d).alias("dist"))
        seen = seen.unionByName(front)
    return seen


def closeness(nodes: DataFrame, arcs: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(node, closeness, harmonic) of the sources over what lies within ``depth``."""
    n = nodes.agg(F.count("*").alias("n"))
    rows = distances(arcs, sources, depth).filter("dist > 0").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("r"), F.sum("dist").alias("total"), F.sum(1.0 / F.col("dist")).alias("harmonic"))
    rows = sources.select("node").join(rows, "node", "left").crossJoin(n)
    near = F.col("r") / F.col("total") * F.col("r") / F.nullif(F.col("n") - 1, F.lit(0))
    return rows.select("node", F.coalesce(near, F.lit(0.0)).alias("closeness"), F.coalesce("harmonic", F.lit(0.0)).alias("harmonic"))


def _slots(to: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
    """(place, slots, more): nodes placed by falling degree; the j-th neighbour of all that have one, which are the first places; what hubs have beyond SLOTS, in stretches (first place, neighbours, where each node begins)."""
    deg = np.bincount(own, minlength=n)
    rank = np.argsort(-deg, kind="stable")
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    deg = deg[rank]
    to = place[to[np.argsort(place[own], kind="stable")]].astype(np.int32)
    start = np.concatenate([[0], np.cumsum(deg)])
    slots = [to[start[: np.searchsorted(-deg, -j)] + j] for j in range(min(int(deg[0]), SLOTS))]
    hubs, more, lo = int(np.searchsorted(-deg, -SLOTS)), [], 0
    while lo < hubs:
        hi = max(lo + 1, min(int(np.searchsorted(start[: hubs + 1], start[lo] + STRETCH)) - 1, (lo // ROWS + 1) * ROWS))
        sizes = deg[lo:hi] - SLOTS
        begin = np.cumsum(sizes) - sizes
        more.append((lo, to[np.repeat(start[lo:hi] + SLOTS - begin, sizes) + np.arange(sizes.sum())], begin))
        lo = hi
    return place, slots, more


def _spread(slots: list, more: list, n: int, sources: np.ndarray, hung: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place the number of sources that reach it, the sum of their distances and of the inverses, and of the inverses of one step more; one bit a source.

    ``hung`` leaves at each place count as sources one step behind it.  A level reads
    only nodes that some source has yet to reach; while few nodes gained a source in
    the level before, only those next to them.
    """
    if hung is None:
        hung = np.zeros(n, np.int64)
    sources = sources[np.argsort(-hung[sources], kind="stable")]
    leaves, k = hung[sources], len(sources)
    word, bit = np.arange(k) // 64, np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
    seen = np.zeros((n, -(-k // 64)), np.uint64)
    seen[sources, word] = bit
    planes, few = [], -(-int((leaves > 0).sum()) // 64)  # bits of the numbers of leaves, each a mask of sources
    for b in range(int(leaves.max(initial=0)).bit_length()):
        mask = np.zeros(few, np.uint64)
        has = np.flatnonzero(leaves >> b & 1)
        np.bitwise_or.at(mask, word[has], bit[has])
        planes.append((b, mask))
    after, own, held, got = seen.copy(), *[np.empty_like(seen[:ROWS]) for _ in range(3)]
    met = np.bitwise_count(seen).sum(axis=1, dtype=np.int64)
    reached, total, inverse, longer = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for sums, x in ((reached, leaves), (total, leaves), (inverse, leaves), (longer, 1 + leaves / 2)):
        sums[sources] = x
    sizes = np.array([len(s) for s in slots], np.int64)
    live, d = np.sort(sources), 0
    while len(live) and len(slots):
        d += 1
        near = met < k
        near[len(slots[0]) :] = False
        if len(live) * FEW < n:
            next_ = np.zeros(n, bool)
            for s, c in zip(slots, np.searchsorted(live, sizes)):
                next_[s[live[:c]]] = True
            for first, s, begin in more:
                lo, hi = np.searchsorted(live, (first, first + len(begin)))
                for i in live[lo:hi] - first:
                    next_[s[begin[i] : begin[i + 1] if i + 1 < len(begin) else None]] = True
            near &= next_
        todo, gained = np.flatnonzero(near), [np.empty(0, np.int64)]
        rest = live[~near[live]]  # both tables are equal but for the last level's gains; what is read now is written below
        for lo in range(0, len(rest), ROWS):
            rows = rest[lo : lo + ROWS]
            after[rows] = seen[rows]
        for lo in range(0, len(todo), ROWS):
            rows = todo[lo : lo + ROWS]
            now, before = own[: len(rows)], held[: len(rows)]
            np.take(seen, rows, axis=0, out=before, mode="clip")
            np.take(seen, slots[0][rows], axis=0, out=now, mode="clip")
            for s, c in zip(slots[1:], np.searchsorted(rows, sizes[1:])):
                if not c:
                    break
                np.take(seen, s[rows[:c]], axis=0, out=got[:c], mode="clip")
                now[:c] |= got[:c]
            for first, s, begin in more:
                i, j = np.searchsorted(rows, (first, first + len(begin)))
                if i < j and len(begin) == 1:  # a hub of any size, by pieces
                    for x in range(0, len(s), STRETCH):
                        now[i] |= np.bitwise_or.reduce(seen[s[x : x + STRETCH]], axis=0)
                elif i < j:
                    now[i:j] |= np.bitwise_or.reduceat(seen[s], begin, axis=0)[rows[i:j] - first]
            now |= before
            after[rows] = now
            now ^= before
            found = np.bitwise_count(now).sum(axis=1, dtype=np.int64)
            behind = sum((np.bitwise_count(now[:, :few] & mask).sum(axis=1, dtype=np.int64) << b for b, mask in planes), np.zeros(len(rows), np.int64))
            met[rows] += found
            reached[rows] += found + behind
            total[rows] += d * found + (d + 1) * behind
            inverse[rows] += found / d + behind / (d + 1)
            longer[rows] += found / (d + 1) + behind / (d + 2)
            gained.append(rows[found > 0])
        live = np.concatenate(gained)
        seen, after = after, seen
    return reached, total, inverse, longer


def _searched(key: tuple, table: pa.Table) -> pa.Table:
    """(node, reached, total, inverse) that the sources of one share, and the leaves next to them, add to every node of their component.

    Leaves are left out of the search: one is a step farther from everything than its neighbour.
    """
    share, shares = key[1].as_py(), table.column("shares")[0].as_py()
    m = len(table)
    ids, both = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    x, y = both[:m], both[m:]
    end = np.arange(len(ids))
    end[x] = y
    leaf = np.bincount(x, minlength=len(ids)) == 1
    leaf &= ~(leaf[end] & (end > np.arange(len(ids))))  # of two leaves together one stays
    inner = np.cumsum(~leaf) - 1
    n, kept = int(inner[-1]) + 1, ~(leaf[x] | leaf[y])
    place, slots, more = _slots(inner[y[kept]], inner[x[kept]], n)
    to = inner[end[leaf]]
    hung = np.bincount(place[to], minlength=n)
    del both, x, y, kept
    sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    width = max(64, min(WIDTH, HELD // n // 64 * 64))
    mine = place[share::shares].copy()
    for lo in range(0, len(mine), width):
        if lo == width:  # sources about as far from everything are searched together: their searches end together
            mine[lo:] = mine[lo:][np.argsort((sums[1] / np.maximum(sums[0], 1))[mine[lo:]], kind="stable")]
        for s, x in zip(sums, _spread(slots, more, n, mine[lo : lo + width], hung)):
            s += x
    reached, total, inverse, longer = (s[place] for s in sums)
    itself = np.arange(n) % shares == share  # what a leaf finds of itself goes off again
    out = [np.empty(len(ids), s.dtype) for s in (reached, total, inverse)]
    for o, of_inner, of_leaf in zip(out, (reached, total, inverse), (reached, total + reached - itself, longer - itself / 2)):
        o[~leaf], o[leaf] = of_inner, of_leaf[to]
    return pa.table([pa.array(ids), *[pa.array(o) for o in out]], names=["node", "reached", "total", "inverse"])


def whole_closeness(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, closeness, harmonic) of every node over all that it reaches; arcs go both ways.

    Components are searched apart: a task holds one (small ones together), a large
    one goes to several tasks with a share of its nodes as sources each.  Since
    distances are the same both ways, a source adds to the nodes it reaches.
    """
    ship(nodes.sparkSession)
    arcs = stored(arcs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).filter("src <> dst"))
    part = stored(components(arcs.toDF("a", "b")))
    sizes = part.groupBy("component").agg(F.count("*").alias("size"))
    linked, small = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("size") <= SOURCES, F.col("size"))), F.lit(0))).collect()[0]
    share = max(SHARE, -(-linked // MAX_SHARES))
    few = F.col("size") <= SOURCES
    group = F.when(few, -1 - F.pmod(F.xxhash64("component"), F.lit(max(1, small // (4 * SOURCES))))).otherwise(F.col("component"))
    sizes = sizes.select("component", F.when(few, F.lit(False)).otherwise(True).alias("large"), group.alias("group"), F.when(few, 1).otherwise(F.ceil(F.col("size") / share)).cast("int").alias("shares"))
    rows = arcs.join(part.join(sizes, "component").select(F.col("id").alias("src"), "large", "group", "shares"), "src")
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rows = rows.select("large", "group", "share", "shares", "src", "dst").repartition(max(1, min(4 * MAX_SHARES, 4 * linked // SOURCES)), "large", "group", "share")
    found = rows.groupBy("large", "group", "share")
    n = nodes.count()
    sums = found.applyInArrow(lambda key, t: _searched(key[1:], t), "node bigint, reached bigint, total bigint, inverse double")
    sums = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("reached", "total", "inverse")])
    near = F.col("reached") / F.col("total") * F.col("reached") / max(n - 1, 1)
    return nodes.select(F.col("node").cast("bigint").alias("node")).join(sums, "node", "left").select("node", F.coalesce(near, F.lit(0.0)).alias("closeness"), F.coalesce("inverse", F.lit(0.0)).alias("harmonic"))


def normalized_laplacian(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(row, col, value) of I - D^-1/2 A D^-1/2, non-zero entries; isolated nodes keep a unit diagonal."""
    deg = graph.degree(nodes, arcs)
    off = arcs.join(deg.select(F.col("node").alias("src"), F.col("deg").alias("a")), "src").join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("b")), "dst")
    off = off.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-1.0 / F.sqrt(F.col("a") * F.col("b"))).alias("value"))
    return off.unionByName(nodes.select(F.col("node").alias("row"), F.col("node").alias("col"), F.lit(1.0).alias("value")))


def bundle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The joined per-node features that need no iteration."""
    arcs = graph.symmetric(edges)
    parts = [graph.clustering(nodes, edges), h_index(nodes, arcs), average_neighbour_degree(nodes, arcs), spreading_index(nodes, arcs), influence_power(nodes, edges)]
    return reduce(lambda a, b: a.join(b, "node"), parts)


#: Columns of the feature matrix, in order; the first three, six or all twelve are computed.
COLUMNS = ("deg", "h_index", "core", "pagerank", "nip", "si", "cc", "degree_centrality", "closeness", "harmonic", "avg_nbr_deg", "eigen")


def columns(nodes: DataFrame, edges: DataFrame, count: object = 12) -> DataFrame:
    """(node, ``count`` numbers): the features of COLUMNS, all double, for every node.

    Below 6 the first three are computed, below 12 the first six; what is asked for
    beyond them is ``pad_1``, ``pad_2``, ... of zeros, what is computed beyond
    ``count`` is cut. A count that is no number means 3.  Degrees and clustering are
    written once and meet along the arcs once, for four of the columns.
    """
    try:
        count = int(count)
    except (TypeError, ValueError):
        count = 3
    computed = 12 if count >= 12 else 6 if count >= 6 else 3
    names = COLUMNS[: max(0, min(count, computed))]
    arcs = stored(graph.symmetric(edges))
    own = stored(graph.clustering(nodes, edges))
    near = arcs.join(own.toDF("src", "deg", "cc"), "src").join(own.toDF("dst", "nbr_deg", "nbr_cc"), "dst")
    near = stored(near.select(F.col("src").alias("node"), "deg", "nbr_deg", "nbr_cc"))
    each = F.sqrt(F.col("deg") * F.col("deg") + F.col("nbr_deg") * F.col("nbr_deg"))
    sums = near.groupBy("node").agg(F.avg("nbr_deg").alias("avg_nbr_deg"), F.avg(each).alias("si"), F.sum(F.col("nbr_deg") / (F.col("nbr_cc") + 1.0)).alias("x"))
    n = own.count()
    rows = own.join(sums, "node", "left").withColumn("nip", F.col("deg") + 2.0 / (F.col("cc") + 1.0) * F.col("x"))
    rows = rows.withColumn("degree_centrality", F.col("deg") / F.lit(float(max(n - 1, 1))))
    more = {
        "h_index": lambda: _h_of(near, "nbr_deg", "h_index"),
        "core": lambda: core_numbers(nodes, arcs),
        "pagerank": lambda: pagerank(nodes, arcs).select("node", F.col("rank").alias("pagerank")),
        "closeness": lambda: whole_closeness(nodes, arcs),
        "eigen": lambda: krylov.leading(nodes, arcs)[0].withColumnRenamed("x", "eigen"),
    }
    for name in names:
        if name in more:
            rows = rows.join(more[name](), "node", "left")
    out = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]
    return rows.select("node", *out, *[F.lit(0.0).alias(f"pad_{i + 1}") for i in range(count - len(names))])


def max_normalised(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns over their maximum; a column without positive values stays."""
    top = features.agg(*[F.max(c).cast("double").alias(f"max_{c}") for c in columns])
    scaled = [(F.col(c) / F.when(F.col(f"max_{c}") > 0, F.col(f"max_{c}")).otherwise(1.0)).alias(c) for c in columns]
    return features.crossJoin(top).select("node", *scaled)


def alpha(nodes: DataFrame, arcs: DataFrame, heads: int = 8) -> DataFrame:
    """(node, w): soft-max of heads / in-degree, exponent 0 for isolated nodes; sums to 1."""
    e = graph.degree(nodes, arcs).select("node", F.exp(F.when(F.col("deg") > 0, heads / F.col("deg").cast("double")).otherwise(0.0)).alias("e"))
    total = e.agg(F.sum("e").alias("total"))
    return e.crossJoin(total).select("node", (F.col("e") / F.col("total")).alias("w"))
