"""Products of two sides of vectors (idx, z), block by block inside tasks: pairs never become rows.

``best_of_each`` finds each row's most similar partners exactly.  The right side
is cut into cells around pivots; within a cell cosines are bounded by the angles
to its pivot (the triangle inequality on the sphere).  Each row visits its own
cell first, and then only cells whose bound comes up to its k-th best so far.
Small cells travel in groups, and a row that visits several cells of a group is
sent there once, with their numbers; crowded cells are cut into chunks, and a group
with many visitors is dealt to several tasks, so that neither a crowded cell nor a
sought one is one task's work.  On evenly spread vectors all cells are visited; a
task then still holds one group and one share of rows, and sends rows on in
frames of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored

#: Rows of either side in one task's product, and pivots at most (their vectors are sent to all tasks).
BLOCK = 4_096
PIVOTS = 1_024
#: Rows that a cell is meant to hold.
CELL = 512
#: Blocks of rows in a group of cells, and in the rows that visit it together.
WIDE = 4
#: Rows of a frame whose bounds are looked at together, and numbers of a matrix of products.
SLICE = 1_024
TILE = 1 << 21


def unit(z: pd.Series) -> np.ndarray:
    """Rows scaled to length 1; zero, null and non-finite vectors become zeros."""
    size = max((len(v) for v in z if v is not None), default=0)
    x = np.zeros((len(z), size))
    for i, v in enumerate(z):
        if v is not None and len(v) == size:
            x[i] = v
    x[~np.isfinite(x).all(1)] = 0.0
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _doubles(side: DataFrame, *more: str) -> DataFrame:
    return side.select("idx", F.col("z").cast("array<double>").alias("z"), *more)


def _dealt(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
    """Each row with its block and, in turn, all blocks of the other side."""
    side = side.withColumn(own, F.pmod(F.xxhash64("idx"), F.lit(-(-n // BLOCK) or 1)).cast("int"))
    return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-m // BLOCK) - 1)))))


def by_blocks(left: DataFrame, right: DataFrame, reduce: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """``reduce`` of every two blocks: small frames, to be merged by the caller."""
    ship(left.sparkSession)
    n, m = left.count(), right.count()
    names = [c.split(" ")[0] for c in shape.split(", ")]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b.columns = [c[1:] for c in b.columns]
        return reduce(a, b) if len(a) and len(b) else pd.DataFrame(columns=names)

    a, b = _dealt(left, "_l", n, "_r", m), _dealt(right, "_r", m, "_l", n)
    b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])  # both sides may be one table
    return a.groupBy("_l", "_r").cogroup(b.groupBy("__l", "__r")).applyInPandas(run, shape)


def best_pairs(left: DataFrame, right: DataFrame, top: int, digits: int = 12, others: bool = False) -> DataFrame:
    """(a, b, sim): the ``top`` most similar of all pairs, smaller ids first among equals; each block sends on that many at most."""

    def reduce(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ia, ib = a["idx"].to_numpy(), b["idx"].to_numpy()
        s = np.round(unit(a["z"]) @ unit(b["z"]).T, digits)
        if others:
            s[ia[:, None] == ib[None, :]] = -np.inf
        flat = s.ravel()
        if top < len(flat):
            edge = np.partition(flat, len(flat) - top)[len(flat) - top]
            over, ties = np.flatnonzero(flat > edge), np.flatnonzero(flat == edge)
            rest = top - len(over)
            ties = ties[np.lexsort((ib[ties % len(ib)], ia[ties // len(ib)]))[:rest]]
            at = np.concatenate([over, ties])
        else:
            at = np.arange(len(flat))
        at = at[np.isfinite(flat[at])]
        return pd.DataFrame({"a": ia[at // len(ib)], "b": ib[at % len(ib)], "sim": flat[at]})

    found = by_blocks(_doubles(left), _doubles(right), reduce, "a bigint, b bigint, sim double")
    return found.orderBy(F.desc("sim"), "a", "b").limit(top)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _grouped(held: dict[int, int]) -> dict[int, int]:
    """The group of each cell: cells in turn, as long as they fit together."""
    out, group, size = {}, -1, WIDE * BLOCK
    for c in sorted(held):
        if size + held[c] > WIDE * BLOCK:
            group, size = group + 1, 0
        out[c], size = group, size + held[c]
    return out


def _best_of(s: np.ndarray, ia: np.ndarray, ib: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest of each row of products, smaller ids first among equals; -inf is none."""
    if s.shape[1] > k:
        row, at = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    else:
        row, at = np.divmod(np.arange(s.size), s.shape[1])
    sim = s[row, at]
    order = np.lexsort((ib[at], -sim, row))
    order = order[np.isfinite(sim[order])]
    begin = np.searchsorted(row[order], np.arange(len(s)))
    order = order[np.arange(len(order)) - begin[row[order]] < k]
    return ia[row[order]], ib[at[order]], sim[order]


def _visits(queries: DataFrame, cells: DataFrame, held: dict[int, int], k: int, digits: int, others: bool) -> DataFrame:
    """(a, b, sim): the k best of each visited chunk. ``queries(idx, z, group, wanted)``, ``cells(idx, z, cell, group)``."""
    rows: dict[int, int] = {}
    for c, g in _grouped(held).items():
        rows[g] = rows.get(g, 0) + held[c]
    wanted = {r["group"]: r["count"] for r in queries.groupBy("group").count().collect()}  # a row a group at most
    per_group = lambda counts: F.element_at(F.create_map(*[F.lit(x) for g in rows for x in (g, max(1, -(-counts.get(g, 0) // (WIDE * BLOCK))))]), F.col("group"))
    chunks, shares = per_group(rows), per_group(wanted)
    right = cells.withColumn("chunk", F.pmod(F.xxhash64("idx"), chunks).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    left = queries.withColumn("share", F.pmod(F.xxhash64("idx", F.lit(1)), shares).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "sim": []})
        if a.empty or b.empty:
            return none
        parts = [(cell, part["idx"].to_numpy(), np.stack(part["z"].to_numpy())) for cell, part in b.groupby("cell")]
        out = []
        for start in range(0, len(a), SLICE):  # a slice meets all cells and is cut to its best before the next one
            some = a.iloc[start : start + SLICE]
            ia, x = some["idx"].to_numpy(), np.stack(some["z"].to_numpy())
            seen, of = np.concatenate(some["wanted"].to_numpy()), np.repeat(np.arange(len(some)), some["wanted"].str.len())
            met = []
            for cell, ib, y in parts:
                mine = of[seen == cell]
                step = max(1, TILE // len(y))
                for lo in range(0, len(mine), step):
                    at = mine[lo : lo + step]
                    s = np.round(x[at] @ y.T, digits)
                    if others:
                        s[ia[at][:, None] == ib[None, :]] = -np.inf
                    met.append(_best_of(s, ia[at], ib, k))
            if met:
                found = pd.DataFrame({c: np.concatenate(v) for c, v in zip(("a", "b", "sim"), zip(*met))})
                found = found.sort_values(["a", "sim", "b"], ascending=[True, False, True], kind="stable")
                out.append(found[found.groupby("a").cumcount() < k])
        return pd.concat(out) if out else none

    keys = ("group", "chunk", "share")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "a bigint, b bigint, sim double")


def best_of_each(left: DataFrame, right: DataFrame, k: int, digits: int = 12, others: bool = False, share: dict | None = None) -> DataFrame:
    """(a, b, sim, rank): each row's k partners of highest cosine, smaller ids first among equals; exact.

    Cosines are compared at ``digits`` places; that of a zero vector is 0.
    With ``others`` a row is not its own partner.  ``share`` receives the number
    of products formed and of all pairs.
    """
    spark = left.sparkSession
    ship(spark)
    m = right.count()
    if not m:
        return left.sparkSession.createDataFrame([], "a bigint, b bigint, sim double, rank int")
    want = max(1, min(PIVOTS, -(-m // CELL)))
    drawn = right.select("idx", "z").filter(F.exists("z", lambda v: v != 0)).orderBy(F.xxhash64("idx"), "idx").limit(want)
    vectors = [r["z"] for r in _doubles(drawn).orderBy(F.xxhash64("idx"), "idx").collect()]  # PIVOTS rows at most
    pivots = unit(pd.Series(vectors)) if vectors else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(pivots)

    def assign(frames):
        p = sent.value
        for f in frames:
            x = unit(f["z"])
            if x.shape[1] != p.shape[1]:
                x = np.zeros((len(f), p.shape[1]))
            s = np.clip(x @ p.T, -1.0, 1.0)
            cell = s.argmax(1)
            f = f.assign(cell=cell.astype(np.int32), angle=np.arccos(s[np.arange(len(s)), cell]))
            f["z"] = pd.Series(list(x), index=f.index, dtype=object)
            yield f[["idx", "z", "cell", "angle"]]

    placed = "idx bigint, z array<double>, cell int, angle double"
    cells = stored(_doubles(right).mapInPandas(assign, placed))
    mine = cells if left is right else stored(_doubles(left).mapInPandas(assign, placed))
    bounds = {r["cell"]: (r["n"], r["lo"], r["hi"], r["zero"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.max(F.forall("z", lambda v: v == 0)).alias("zero")).collect()}
    held = {c: b[0] for c, b in bounds.items()}
    group = _grouped(held)
    of_cell = F.element_at(F.create_map(*[F.lit(x) for c in group for x in (c, group[c])]), F.col("cell")).alias("group")
    home = mine.filter(F.col("cell").isin(list(held)))
    own = home.select("idx", "z", of_cell, F.array("cell").alias("wanted"))
    cells = cells.select("idx", "z", "cell", of_cell)
    first = stored(_best(_visits(own, cells, held, k, digits, others), k).drop("rank"))
    floor = first.groupBy(F.col("a").alias("idx")).agg(F.min("sim").alias("low"), F.count("*").alias("n")).filter(F.col("n") >= k).select("idx", "low")
    asked = mine.join(floor, "idx", "left").select("idx", "z", "cell", "low")
    order = sorted(bounds)
    lo, hi = (np.array([bounds[c][i] for c in order]) for i in (1, 2))
    zero = np.array([bool(bounds[c][3]) for c in order])

    def others_worth(frames):
        p = sent.value[order]
        for f in frames:
            for start in range(0, len(f), SLICE):
                yield from worth(f.iloc[start : start + SLICE], p)

    groups = np.array([group[c] for c in order])
    numbers = np.array(order, np.int32)

    def worth(f, p):
        x = np.stack(f["z"].to_numpy())
        angle = np.arccos(np.clip(x @ p.T, -1.0, 1.0))
        gap = np.maximum(0.0, np.maximum(lo - angle, angle - hi))
        top = np.cos(np.minimum(gap, np.pi))
        top[~x.any(1)] = 0.0
        top[:, zero] = np.maximum(top[:, zero], 0.0)  # a zero vector's cosine is 0, whatever its angle
        low = f["low"].fillna(-np.inf).to_numpy(dtype=float)
        ok = (top + 1e-9 >= low[:, None]) & (numbers[None, :] != f["cell"].to_numpy()[:, None])
        idx = f["idx"].to_numpy()
        for g in np.unique(groups):  # a frame of one slice and group at a time
            of = np.flatnonzero(groups == g)
            row = np.flatnonzero(ok[:, of].any(1))
            if len(row):
                yield pd.DataFrame({"idx": idx[row], "z": pd.Series(list(x[row]), dtype=object), "group": np.int32(g), "wanted": pd.Series([numbers[of[ok[i, of]]] for i in row], dtype=object)})

    further = stored(asked.mapInPandas(others_worth, "idx bigint, z array<double>, group int, wanted array<int>"))
    if share is not None:
        seen = home.select("cell").unionByName(further.select(F.explode("wanted").alias("cell"))).groupBy("cell").count().collect()
        share |= {"products": sum(r["count"] * held[r["cell"]] for r in seen), "pairs": mine.count() * m}
    second = _visits(further, cells, held, k, digits, others)
    return _best(first.unionByName(second), k)
