"""Operator 7: MinHash near-duplicates with tensored banding.

Each text becomes a set of word shingles.  Two groups of ``m`` small
collections, each of ``r`` minhashes, are computed per set; every pair of one
collection from either group forms the key of a table, so that ``m * m``
tables cost ``2 * m * r`` minhashes only.  Texts that meet in a table are
verified on their full sets.

Copies with equal sets are one class from the start, and only its first
document is compared.  In a bucket the members are not paired all with all:
in each star round they are held against one member of the bucket, and what
has been linked, directly or through others, is not compared again; a last
round compares what still differs, in blocks of a bucket.  So no link between bucket mates is lost,
and a group of thousands of copies costs about one comparison a copy.

At a similarity of 0.8 a pair meets in no table with a probability of about
2 * (1 - 0.8**r)**m, 0.06 % with the defaults, and less above.

Null texts, and texts without words, have an empty set and link with nothing.
Rows of one doc_id share their fate; rows with a null doc_id link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, arrow_chunks, frugal, give_back, mix64, plain, rolling, stored, whole
from .components import components

#: Collections in each of the two groups, and minhashes in each collection.
COLLECTIONS = 8
HASHES = 2
#: Star rounds at most before what still differs is compared; a round that settles less than half of the open buckets is the last one.
STARS = 4
#: Bytes of text that are worked on at once.
CHUNK = 2 << 20
#: One-bit minhashes that a pair is held against before its sets are fetched, and how many may
#: differ: at a similarity of 0.8 a tenth does, and a pair is lost with a probability of 3e-5.
BITS = 192
DIFFERENT = 36
#: Bytes of sets and marks that the last round compares at once (a pair of blocks holds two), and those of one unit of its work, on average.
BLOCK = 4 << 20
UNIT = 8 << 20
#: Pairs up to which their ids are broadcast (16 bytes a pair).
BROADCAST_PAIRS = 100_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the offsets of the rows.

    A-Z count as a-z.  Texts of fewer than ``k`` words have one shingle, the
    whole sequence; texts without words none.
    """
    words = Words(texts, lower=True)
    n = words.rows
    counts = np.diff(words.first)
    docs, hashes = [], []
    h = rolling(words.hash, k)
    if len(h):
        same = words.doc[: len(h)] == words.doc[k - 1 :]
        docs.append(words.doc[: len(h)][same])
        hashes.append(h[same])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = words.first[i], words.first[i + 1]
        docs.append(np.array([i]))
        hashes.append(rolling(words.hash[a:b], b - a, seed=2 + int(b - a)))
    if not docs:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[fresh], h[fresh]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _keys(h: np.ndarray, offsets: np.ndarray, m: int, r: int) -> np.ndarray:
    """(rows, 2 m) collection keys of the non-empty rows."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), 2 * m), np.uint64)
    rng = np.random.default_rng(20240229)
    with np.errstate(over="ignore"):
        for c in range(2 * m):
            key = np.full(len(starts), np.uint64(c + 1))
            for _ in range(r):
                mult, add = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
                v = (h ^ add) * (mult | np.uint64(1))
                v ^= v >> np.uint64(32)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, starts))
            out[:, c] = key
    return out


def _bits(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64) packed one-bit minhashes of the non-empty rows."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), BITS // 64), np.uint64)
    rng = np.random.default_rng(7)
    with np.errstate(over="ignore"):
        for b in range(BITS):
            mult, add = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((h ^ add) * (mult | np.uint64(1)), starts)
            out[:, b // 64] |= ((mix64(least) >> np.uint64(5)) & np.uint64(1)) << np.uint64(b % 64)
    return out


def sketch(docs: DataFrame, k: int, m: int = COLLECTIONS, r: int = HASHES) -> DataFrame:
    """(doc_id, n, d1, d2, keys, bits): set size, a 128-bit digest of the set (null: empty set), collection keys and one-bit minhashes."""
    ship(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_chunks(batches, "text", CHUNK):
            h, offsets = shingle_sets(whole(part.column("text")), k)
            sizes = np.diff(offsets)
            some = sizes > 0
            digests = np.zeros((2, len(sizes)), np.uint64)
            keys = np.zeros((len(sizes), 2 * m), np.uint64)
            bits = np.zeros((len(sizes), BITS // 64), np.uint64)
            if some.any():
                starts = offsets[:-1][some]
                with np.errstate(over="ignore"):
                    digests[0, some] = np.add.reduceat(mix64(h), starts)
                    digests[1, some] = np.add.reduceat(mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                keys[some] = _keys(h, offsets, m, r)
                bits[some] = _bits(h, offsets)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, bits)]
            digest = [pa.array(d.view(np.int64), mask=~some) for d in digests]
            yield pa.RecordBatch.from_arrays([whole(part.column("doc_id")), pa.array(sizes), *digest, *lists], names=["doc_id", "n", "d1", "d2", "keys", "bits"])

    return plain(docs, "doc_id", "text").mapInArrow(run, f"doc_id {ids}, n long, d1 long, d2 long, keys array<long>, bits array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, hashes): the full set of each row as packed 64-bit hashes."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_chunks(batches, "text", CHUNK):
            h, offsets = shingle_sets(whole(part.column("text")), k)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * 8), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([whole(part.column("doc_id")), data.cast(pa.binary())], names=["id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {ids}, hashes binary")


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                keep.append(False)
                continue
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])
    give_back()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    n = pairs.count()
    if n <= BROADCAST_PAIRS:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    kinds = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}"
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored(rows.mapInArrow(lambda batches: _linked(batches, percent), kinds))


def _crossed(table: pa.Table, percent: int, m: int) -> pa.Table:
    """Links between members of differing labels in the buckets (or pairs of bucket blocks) of one unit of work.

    A pair is verified in the first table that it meets in; only links that
    join two groups of a bucket leave it.
    """
    table = table.combine_chunks().sort_by([("key", "ascending"), ("bi", "ascending"), ("bj", "ascending"), ("id", "ascending")])
    n = table.num_rows
    key, bi, bj, own, ids, label = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "own", "id", "label"))
    turn = table.column("t").to_numpy()
    keys, bits = (np.asarray(table.column(c).combine_chunks().flatten().to_numpy()).reshape(n, -1) for c in ("keys", "bits"))
    bits = bits.view(np.uint64)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes").combine_chunks()] if n else []
    sizes = np.array([len(x) for x in sets], np.int64)
    found: list[tuple] = []
    cut = np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    limit = DIFFERENT * max(1, (100 - percent) // 20)
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [n]]).tolist()):
        i, j = divmod(int(turn[a]), m)
        group = label[a:b].copy()
        # within a block each row meets those after it; across blocks each row of bi meets all of bj
        across = bi[a] != bj[a]
        other = a + np.flatnonzero(own[a:b] == bj[a])
        for r in a + np.flatnonzero(own[a:b] == bi[a]) if across else range(a, b - 1):
            rest = other if across else np.arange(r + 1, b)
            ok = group[rest - a] != group[r - a]
            ok &= (100 * sizes[rest] >= percent * sizes[r]) & (100 * sizes[r] >= percent * sizes[rest])
            rest = rest[ok]
            rest = rest[np.bitwise_count(bits[rest] ^ bits[r]).sum(axis=1) <= limit]
            rest = rest[~((keys[rest, :i] == keys[r, :i]).any(axis=1) | (keys[rest, m : m + j] == keys[r, m : m + j]).any(axis=1))]
            if not len(rest):
                continue
            flat = np.concatenate([sets[x] for x in rest])
            at = np.minimum(np.searchsorted(sets[r], flat), len(sets[r]) - 1)
            common = np.add.reduceat((sets[r][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]))
            for x in rest[100 * common >= percent * (sizes[r] + sizes[rest] - common)].tolist():
                if group[x - a] != group[r - a]:
                    found.append((ids[r], ids[x]))
                    group[group == group[x - a]] = group[r - a]
    kind = table.schema.field("id").type
    return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind)})


def _last_round(labelled: DataFrame, mixed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, m: int) -> DataFrame:
    """Links (a, b) in buckets that still hold several groups; sets travel to the buckets, pairs never become rows."""
    weight = F.col("n") * 8 + 256
    left = labelled.join(mixed.select("key"), "key").select("key", "t", "id", "label", weight.alias("weight"))
    sizes = left.groupBy("key").agg(F.sum("weight").alias("size"))
    sizes = sizes.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("long"))
    total = sizes.agg(F.sum(F.col("size").cast("double") * F.col("nb"))).collect()[0][0] or 0
    units = max(1, int(-(-total // UNIT)))
    pieces = left.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")))
    pieces = pieces.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    pieces = pieces.select("key", "t", "id", "label", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    marks = classes.select(F.col("doc_id").alias("id"), "keys", "bits")
    work = pieces.join(marks, "id").join(sets, "id").withColumn("unit_no", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(units)))
    kind = labelled.schema["id"].dataType.simpleString()
    columns = ["unit_no", "key", "t", "id", "label", "own", "bi", "bj", "keys", "bits", "hashes"]
    return stored(work.select(*columns).groupBy("unit_no").applyInArrow(lambda t: frugal(_crossed, t, percent, m), f"a {kind}, b {kind}"))


def _close(percent: int):
    """Whether the sizes and one-bit minhashes of two marks p and q allow for a similarity of ``percent``."""
    sizes = (F.col("p.n") * 100 >= F.col("q.n") * percent) & (F.col("q.n") * 100 >= F.col("p.n") * percent)
    differ = sum((F.bit_count(F.col(f"p.b{i}").bitwiseXOR(F.col(f"q.b{i}"))) for i in range(BITS // 64)), F.lit(0))
    return sizes & (differ <= DIFFERENT * max(1, (100 - percent) // 20))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = COLLECTIONS, r: int = HASHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text, ...)``.

    Documents link when ``100 * intersection >= percent * union`` of their
    sets of ``k``-word shingles.
    """
    docs = plain(docs, "doc_id", "text")
    table = stored(sketch(docs, k, m, r))
    # one row for each set: copies go no further
    live = table.filter(F.col("d1").isNotNull() & F.col("doc_id").isNotNull())
    first = live.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "keys", "bits")).alias("s"))
    classes = stored(first.select("d1", "d2", "s.*"))
    combine = f"flatten(transform(slice(keys, 1, {m}), (x, i) -> transform(slice(keys, {m + 1}, {m}), (y, j) -> xxhash64(x, y, i, j))))"  # table i * m + j
    heads = classes.select(F.col("doc_id").alias("id"), "n", *[F.col("bits")[i].alias(f"b{i}") for i in range(BITS // 64)])
    entries = classes.select(F.col("doc_id").alias("id"), F.posexplode(F.expr(combine)).alias("t", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    buckets = stored(entries.join(shared, "key").join(heads, "id"))
    members = buckets.select("id").distinct()
    sets = stored(_sets(docs.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), k))
    links, turn, before = None, 0, None
    labelled = buckets.withColumn("label", F.col("id"))
    while turn <= STARS:
        # buckets in which not all is linked yet; the first star has the same middle in all
        # buckets of a group, later ones a middle for each bucket, as few texts are left
        order = F.xxhash64("id", F.lit(turn)) if not turn else F.xxhash64("id", "key", F.lit(turn))
        mark = F.struct("n", *[f"b{i}" for i in range(BITS // 64)])
        mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(order, "id", mark.alias("mark"), "label")).alias("c")).filter("lo <> hi")
        mixed = stored(mixed.select("key", "c"))
        still = mixed.count()
        if turn and not still:
            break
        if before is not None and 2 * still > before:
            turn = STARS
        before = still
        x = labelled.select("key", F.col("id").alias("a"), mark.alias("p"), F.col("label").alias("la"))
        if turn < STARS:
            y = mixed.select("key", F.col("c.id").alias("b"), F.col("c.mark").alias("q"), F.col("c.label").alias("lb"))
            pairs = x.join(y, (x["key"] == y["key"]) & (F.col("la") != F.col("lb")) & _close(percent))
            pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            found = _verified(pairs, sets, percent)
        else:
            found = _last_round(labelled, mixed, classes, sets, percent, m)
        links = found if links is None else links.union(found)
        groups = components(links)
        if turn < STARS:
            labels = groups.select("id", F.col("component").alias("to"))
            labelled = stored(buckets.join(labels, "id", "left").withColumn("label", F.coalesce("to", "id")).drop("to"))
        turn += 1
    heads = classes.select("d1", "d2", F.col("doc_id").alias("head"))
    heads = heads.join(groups.select(F.col("id").alias("head"), "component"), "head", "left").select("d1", "d2", F.coalesce("component", "head").alias("component"))
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(heads, ["d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
