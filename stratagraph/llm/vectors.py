"""Operator 10: near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; each of ``tables`` keys is a tuple of quantised random
projections, and vectors that meet under a key are compared by their exact
cosine in double precision.  At cosine 0.98 (distance 0.2) two vectors miss
each other in all tables with a probability of about 2e-5 with the defaults.

Equal vectors of one label are one class from the start.  Buckets are compared
in blocks by matrix products: links are counted where they are found (a pair
that meets in several tables counts in the first), and only a spanning forest
of each block leaves it, so no pair of a large group becomes a row.

Rows whose vector or label is null, whose vector is zero, empty or holds null
or non-finite components, or whose vec_id is null, link with nothing; so do
vectors of different lengths.  Rows of equal vec_id and vector share their
fate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import mix64, plain, stored
from .components import components

MIN_COSINE = 0.98
TABLES = 16
PROJECTIONS = 4
STEP = 1.0
#: Members of a bucket that are compared with each other at once; larger buckets are cut into blocks.
BLOCK = 1024
#: Bucket entries in one unit of work, on average.
UNIT = 8_000


def _keys(units: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(rows, TABLES) keys of normalised vectors."""
    rng = np.random.default_rng(units.shape[1])
    out = np.empty((len(units), TABLES), np.uint64)
    for t in range(TABLES):
        axes = rng.standard_normal((units.shape[1], PROJECTIONS))
        cells = np.floor((units @ axes + rng.uniform(0, STEP, PROJECTIONS)) / STEP).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            key = mix64(labels + np.uint64(t + 1) * np.uint64(0x9E3779B97F4A7C15))
            for j in range(PROJECTIONS):
                key = mix64(key * np.uint64(31) + cells[:, j])
        out[:, t] = key
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("v")
        sizes = np.array([len(x) for x in vectors], np.int64)
        labels = batch.column("tag").to_numpy(zero_copy_only=False).view(np.uint64)
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            part = batch.take(pa.array(mine))
            raw = np.array(part.column("v").to_pylist(), np.float64).reshape(len(mine), size)
            scale = np.abs(raw).max(axis=1, keepdims=True)
            units = raw / scale
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            keys = _keys(units, labels[mine] + np.uint64(size))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("mult"), pa.array([u.tobytes() for u in units], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), TABLES).cast(pa.list_(pa.int64()))],
                names=["id", "mult", "unit", "keys"],
            )


def _compare(table: pa.Table, least: float) -> pa.Table:
    """Link counts and forest edges of the block pairs in one unit of work."""
    table = table.combine_chunks().sort_by([("key", "ascending"), ("bi", "ascending"), ("bj", "ascending"), ("id", "ascending")])
    n = table.num_rows
    key, bi, bj, own = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "own"))
    ids, mult, turn = (table.column(c).to_numpy() for c in ("id", "mult", "t"))
    units = [np.frombuffer(x.as_buffer(), np.float64) for x in table.column("unit").combine_chunks()] if n else []
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(n, -1)
    cut = np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    links = np.zeros(n, np.int64)
    root = ids.copy()
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [n]]).tolist()):
        x = np.stack(units[a:b])
        if bi[a] == bj[a]:
            p, q = np.nonzero(np.triu(x @ x.T >= least, 1))
        else:
            left, right = np.flatnonzero(own[a:b] == bi[a]), np.flatnonzero(own[a:b] == bj[a])
            p, q = np.nonzero(x[left] @ x[right].T >= least)
            p, q = left[p], right[q]
        if not len(p):
            continue
        parent = np.arange(b - a)

        def top(i: int, parent=parent) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # hang every vector on its first partner, then join the rest
        for i, j in zip(p.tolist(), q.tolist()):
            if parent[i] != parent[j]:
                u, v = top(i), top(j)
                parent[max(u, v)] = min(u, v)
        t = int(turn[a])
        if t:
            first = np.concatenate([~(keys[a + p[s : s + 65536], :t] == keys[a + q[s : s + 65536], :t]).any(axis=1) for s in range(0, len(p), 65536)])
            p, q = p[first], q[first]
        links[a:b] += np.bincount(p, mult[a + q], b - a).astype(np.int64) + np.bincount(q, mult[a + p], b - a).astype(np.int64)
        root[a:b] = [ids[a + top(i)] for i in range(b - a)]
    some = pa.array((links > 0) | (root != ids))
    return pa.table({"id": pa.array(ids).filter(some), "links": pa.array(links).filter(some), "root": pa.array(root).filter(some)})


def near_vectors(vectors: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label, ...)``; vec_id is a bigint.

    Rows that repeat a vec_id with other vectors or labels are one member with
    several vectors: the links of all of them are added, and what any of them
    reaches is one component.
    """
    ship(vectors.sparkSession)
    rows = plain(vectors, "vec_id", "embedding", "label")
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("ok", F.coalesce(F.expr(f"vec_id is not null and label is not null and embedding is not null and {finite}"), F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.expr("transform(embedding, x -> double(x) + 0.0D)")))
    classes = rows.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"))
    source = classes.select("id", "mult", "v", F.xxhash64("label").alias("tag"))
    heads = stored(source.mapInArrow(_hashed, "id long, mult long, unit binary, keys array<long>"))
    entries = heads.select("id", F.posexplode("keys").alias("t", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(entries.join(shared, "key"))
    total = members.count()
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("id"), blocks)
    pieces = members.withColumn("nb", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    pieces = pieces.select("id", "t", "key", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    units = max(1, -(-total // UNIT))
    pieces = pieces.withColumn("unit_no", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(units)))
    work = pieces.join(heads, "id").select("unit_no", "id", "t", "key", "own", "bi", "bj", "mult", "unit", "keys")
    found = stored(work.groupBy("unit_no").applyInArrow(lambda t: _compare(t.drop_columns(["unit_no"]), least), "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    mine = classes.select("label", "v", "id", "mult").join(counts, "id", "left").join(groups, "id", "left")
    mine = mine.select("label", "v", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.join(mine, ["label", "v"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
