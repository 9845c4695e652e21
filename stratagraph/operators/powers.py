"""Powers of the random walk as sparse tables, by block products inside tasks.

A product is cut three ways.  Middle nodes are dealt to tasks; one with many
entries on either side is cut into parts on both, and every two parts meet in
one task, so that a hub is nobody's square.  A task adds up what it forms
before it sends anything on.

Wanted pairs need no whole power: the arcs go both ways, so that a walk of i
steps from s to d is one of a = ceil(i / 2) steps from s and one of i - a steps
from d that meet, weighted by their degrees.  Only powers up to half of the
longest walk are formed, and their rows go only where a wanted pair asks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored

#: Entries of a side that one task holds on average; entries of a middle node in one part; products formed at once.
ENTRIES = 1 << 18
PART = 1 << 10
PRODUCTS = 1 << 21
#: Two-step entries that one task of wanted arcs holds on average, and that come to one node at most.
GATHERED, LIGHT = 1 << 20, 1 << 20


def step(arcs: DataFrame) -> DataFrame:
    """(src, dst, p): one step along any arc of a node, each as likely."""
    deg = arcs.groupBy("src").agg(F.count("*").cast("double").alias("_deg"))
    return arcs.join(deg, "src").select("src", "dst", (1.0 / F.col("_deg")).alias("p"))


def _slices(sizes: np.ndarray):
    """Ranges of rows whose sizes come to PRODUCTS or less; a larger row stands alone."""
    at, lo, total = np.cumsum(sizes), 0, len(sizes)
    while lo < total:
        before = at[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(at, before + PRODUCTS, "right")))
        yield lo, hi
        lo = hi


def _unfold(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with a run (first, size) each: the row and the place of every member of its run."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _product(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    b.columns = [c[1:] for c in b.columns]
    if a.empty or b.empty:
        return pd.DataFrame({"src": [], "dst": [], "p": []})
    both = pd.concat([a[["mid", "l", "r"]], b[["mid", "l", "r"]]]).groupby(["mid", "l", "r"]).ngroup().to_numpy()
    ka, kb = both[: len(a)], both[len(a) :]
    order = np.argsort(kb, kind="stable")
    first, last = np.searchsorted(kb[order], ka), np.searchsorted(kb[order], ka, "right")
    src, sources = pd.factorize(a["src"])
    dst, targets = pd.factorize(b["dst"].to_numpy()[order])
    pa, pb = a["p"].to_numpy(), b["p"].to_numpy()[order]
    keys, sums = [], []
    for lo, hi in _slices(last - first):
        row, at = _unfold(first[lo:hi], (last - first)[lo:hi])
        k, where = np.unique(src[lo + row].astype(np.int64) * len(targets) + dst[at], return_inverse=True)
        keys.append(k)
        sums.append(np.bincount(where, pa[lo + row] * pb[at], len(k)))
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(sums), len(k))
    return pd.DataFrame({"src": np.asarray(sources)[k // len(targets)], "dst": np.asarray(targets)[k % len(targets)], "p": total})


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst, p) of the matrix product of two sparse tables; entries that no middle node gives are left out."""
    ship(left.sparkSession)
    ins, outs = left.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("n")), right.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("m"))
    counts = ins.join(outs, "mid")
    formed = int(counts.agg(F.sum(F.col("n").cast("double") * F.col("m"))).collect()[0][0] or 0)
    parts = counts.select("mid", F.ceil(F.col("n") / PART).alias("_n"), F.ceil(F.col("m") / PART).alias("_m"))
    tasks = F.lit(-(-formed // PRODUCTS) or 1)
    task = F.pmod(F.xxhash64("mid", "l", "r"), tasks).alias("task")
    a = left.withColumnRenamed("dst", "mid").join(parts, "mid").withColumn("l", F.pmod(F.xxhash64("src"), F.col("_n"))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)))
    b = right.withColumnRenamed("src", "mid").join(parts, "mid").withColumn("r", F.pmod(F.xxhash64("dst"), F.col("_m"))).withColumn("l", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    a = a.select(task, "mid", "l", "r", "src", "p")
    b = b.select(task, "mid", "l", "r", "dst", "p")
    b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])  # both sides may be one table
    formed = a.groupBy("task").cogroup(b.groupBy("_task")).applyInPandas(_product, "src bigint, dst bigint, p double")
    return formed.groupBy("src", "dst").agg(F.sum("p").alias("p"))


def all_pairs(arcs: DataFrame, k: int) -> DataFrame:
    """(src, dst, p1..pk): walk probabilities of all pairs that some walk of at most ``k`` steps joins; each power is written once."""
    one = stored(step(arcs))
    rows, power = one.withColumn("_i", F.lit(1)), one
    for i in range(2, k + 1):
        power = stored(product(power, one))
        rows = rows.unionByName(power.withColumn("_i", F.lit(i)))
    own = [F.coalesce(F.sum(F.when(F.col("_i") == i, F.col("p"))), F.lit(0.0)).alias(f"p{i}") for i in range(1, k + 1)]
    return rows.groupBy("src", "dst").agg(*own)


def _met(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Sums over the middle nodes of one task for its wanted pairs."""
    names = [f"p{i}" for i in range(1, k + 1)]
    half = (k + 1) // 2
    mids = pd.factorize(rows["y"])[0].astype(np.int64)  # of pairs: the other end
    ends = pd.factorize(rows["x"])[0].astype(np.int64)
    kind = rows["kind"].to_numpy()
    pairs, left, right = (np.flatnonzero(kind == i) for i in range(3))
    if not len(pairs) or not len(left):
        return pd.DataFrame({c: [] for c in ("src", "dst", *names)})
    wide = int(mids.max()) + 1
    lk, rk = ends[left] * wide + mids[left], ends[right] * wide + mids[right]
    left, lk = left[np.argsort(lk)], np.sort(lk)
    right, rk = right[np.argsort(rk)], np.sort(rk)
    near = [rows[f"q{i}"].to_numpy()[left] for i in range(1, half + 1)]
    far = [rows[f"q{i}"].to_numpy()[right] for i in range(1, half + 1)]
    out = np.zeros((k, len(pairs)))
    at = np.searchsorted(lk, ends[pairs] * wide + mids[pairs])
    hit = lk[np.minimum(at, len(lk) - 1)] == ends[pairs] * wide + mids[pairs]
    out[0, hit] = near[0][at[hit]]
    code = pd.Series(ends, index=rows["x"].to_numpy())
    code = code[~code.index.duplicated()]
    other = code.reindex(rows["y"].to_numpy()[pairs]).fillna(-1).to_numpy().astype(np.int64)
    first, last = np.searchsorted(lk, ends[pairs] * wide), np.searchsorted(lk, (ends[pairs] + 1) * wide)
    for lo, hi in _slices(last - first) if len(rk) else ():
        row, place = _unfold(first[lo:hi], (last - first)[lo:hi])
        key = other[lo + row] * wide + lk[place] % wide
        at = np.minimum(np.searchsorted(rk, key), len(rk) - 1)
        hit = (rk[at] == key) & (other[lo + row] >= 0)
        row, place, at = row[hit], place[hit], at[hit]
        for i in range(2, k + 1):
            a = (i + 1) // 2
            out[i - 1, lo:hi] += np.bincount(row, near[a - 1][place] * far[i - a - 1][at], hi - lo)
    return pd.DataFrame({"src": rows["x"].to_numpy()[pairs], "dst": rows["y"].to_numpy()[pairs]} | dict(zip(names, out)))


def of_pairs(pairs: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """(src, dst, p1..pk): walk probabilities of the wanted pairs (each once), 0 where no walk joins them.

    ``arcs`` hold both directions of every edge.
    """
    ship(arcs.sparkSession)
    half = (k + 1) // 2
    qs = [f"q{i}" for i in range(1, half + 1)]
    pairs = pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).filter("src is not null and dst is not null").distinct()
    deg = arcs.groupBy(F.col("src").cast("bigint").alias("node")).agg(F.count("*").cast("double").alias("deg"))
    power = stored(all_pairs(arcs, half).toDF("x", "y", *qs))
    entries, longest = power.groupBy("x").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).collect()[0]
    blocks, cuts = -(-entries // ENTRIES) or 1, -(-longest // ENTRIES) or 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cut = F.pmod(F.xxhash64("y", F.lit(1)), F.lit(cuts)).cast("int")
    none = [F.lit(0.0).alias(q) for q in qs]
    wanted = pairs.select(block("src").alias("i"), block("dst").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("c"), F.lit(0).alias("kind"), F.col("src").alias("x"), F.col("dst").alias("y"), *none)
    near = pairs.select(F.col("src").alias("x"), block("dst").alias("j")).distinct().join(power, "x")
    near = near.select(block("x").alias("i"), "j", cut.alias("c"), F.lit(1).alias("kind"), "x", "y", *qs)
    # what comes back from the other end: P(m, d) = P(d, m) deg(d) / deg(m)
    ratio = F.col("dx.deg") / F.col("dy.deg")
    back = power.join(deg.alias("dx"), F.col("x") == F.col("dx.node")).join(deg.alias("dy"), F.col("y") == F.col("dy.node")).select("x", "y", *[(F.col(q) * ratio).alias(q) for q in qs])
    far = pairs.select(F.col("dst").alias("x"), block("src").alias("i")).distinct().join(back, "x")
    far = far.select("i", block("x").alias("j"), cut.alias("c"), F.lit(2).alias("kind"), "x", "y", *qs)
    names = [f"p{i}" for i in range(1, k + 1)]
    met = wanted.unionByName(near).unionByName(far).groupBy("i", "j", "c").applyInPandas(lambda rows: _met(rows, k), "src bigint, dst bigint, " + ", ".join(f"{c} double" for c in names))
    return met.unionByName(pairs.select("src", "dst", *[F.lit(0.0).alias(c) for c in names])).groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in names])


def _around(table: pa.Table) -> pa.Table:
    """(src, dst, p1..p5) of the arcs out of a task's nodes, from the two-step rows of each node and of its neighbours."""
    lists = table.column("row").combine_chunks()
    entry = lists.flatten()
    row = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
    y, p, dy = (entry.field(c).to_numpy() for c in ("y", "p", "d"))
    src, dst, ds, dd = (table.column(c).to_numpy() for c in ("src", "dst", "ds", "dd"))
    ids, at = np.unique(np.concatenate([y, src, dst]), return_inverse=True)
    y, s, d = np.split(at.astype(np.int64), [len(y), len(y) + len(src)])
    key, own = s[row] * len(ids) + y, (src == dst)[row]

    def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(asked))
        i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[i] == asked, values[i], 0.0)

    order = np.argsort(key[own])
    two, two_p = key[own][order], p[own][order]
    row, p, dy = row[~own], p[~own], dy[~own]
    three, where = np.unique(key[~own], return_inverse=True)
    three_p = np.bincount(where, p / ds[row], len(three))
    back = p * dd[row] / dy  # P(y, d) = P(d, y) deg(d) / deg(y)
    pair = s * len(ids) + d
    four = np.bincount(row, found(two, two_p, three)[where] * back, len(table))
    five = np.bincount(row, three_p[where] * back, len(table))
    out = pa.table({"src": src, "dst": dst, "p1": 1.0 / ds, "p2": found(two, two_p, pair), "p3": found(three, three_p, pair), "p4": four, "p5": five})
    return out.filter(pa.array(src != dst))


def of_arcs(arcs: DataFrame, k: int) -> DataFrame:
    """(src, dst, p1..pk): walk probabilities of all arcs, ``k`` at most 5; both directions of every edge once, no loops.

    Only two-step rows are written: a node gets its own and its neighbours', which
    make its three-step row there and meet it again for the last two steps.  Nodes to
    which more than ``LIGHT`` entries would come go by ``of_pairs``.
    """
    ship(arcs.sparkSession)
    arcs = stored(arcs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")))
    deg = stored(arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg")))
    ends = arcs.join(deg.toDF("dst", "dd"), "dst")
    reach = stored(ends.groupBy(F.col("src").alias("node")).agg(F.sum("dd").alias("two")))
    come = arcs.join(reach.toDF("dst", "two"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("two").alias("come"))
    come = stored(come.join(reach, "node").join(deg, "node").select("node", "deg", "two", (F.col("come") + F.col("two")).alias("come")))
    light = come.filter(F.col("come") <= LIGHT)
    entries, heavy = come.agg(F.coalesce(F.sum(F.when(F.col("come") <= LIGHT, F.col("come"))), F.lit(0)), F.count_if(F.col("come") > LIGHT)).collect()[0]
    names = [f"p{i}" for i in range(1, k + 1)]
    # rows of nodes that are light or next to a light one have few entries
    mids = ends.join(deg.toDF("src", "ds"), "src").select("src", "dst", (1.0 / F.col("ds")).alias("p"), "dd")
    small = come.filter(F.col("two") <= LIGHT).select(F.col("node").alias("x"))
    two = mids.select(F.col("src").alias("x"), F.col("dst").alias("mid"), "p").join(small, "x", "left_semi").join(mids.select(F.col("src").alias("mid"), F.col("dst").alias("y"), F.col("p").alias("q"), "dd"), "mid")
    two = two.groupBy("x", "y").agg(F.sum(F.col("p") * F.col("q")).alias("p"), F.first("dd").cast("int").alias("d"))
    two = stored(two.groupBy("x").agg(F.collect_list(F.struct("y", "p", "d")).alias("row")))
    asked = arcs.unionByName(light.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    asked = asked.join(light.select(F.col("node").alias("src"), F.col("deg").alias("ds")), "src").join(deg.toDF("dst", "dd"), "dst")
    tasks = -(-entries // GATHERED) or 1
    task = F.pmod(F.xxhash64("src"), F.lit(tasks)).alias("task")
    rows = asked.join(two, asked["dst"] == two["x"]).select(task, "src", "dst", "ds", "dd", "row")
    out = rows.groupBy("task").applyInArrow(_around, "src bigint, dst bigint, " + ", ".join(f"p{i} double" for i in range(1, 6))).select("src", "dst", *names)
    if heavy:
        out = out.unionByName(of_pairs(arcs.join(light.select(F.col("node").alias("src")), "src", "left_anti"), arcs, k))
    return out
