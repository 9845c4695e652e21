"""Operator 6: duplicate passages by prefix-partitioned suffix trees.

The suffixes of all texts (one at each word) are split into groups that fit
in memory by prefixes of different lengths: beginnings of two words, counted
over all documents, are packed into groups; where one alone outgrows a group,
its suffixes are split further by their beginnings down to the full depth.
In a group the suffixes are sorted by their first ``width`` words, which puts
the leaves below one node at that depth side by side: each such node with
more than one leaf is a repeat, its earliest leaf the original.  Longer
repeats are runs of such nodes.

Texts are cut into chunks by ranges of doc_id.  A chunk sends each distinct
key once, so a passage that a third of all documents share is a few rows, and
gets one bit back for each.  Keys are 80-bit hashes of the words.

Null texts have no words.  Rows of equal doc_id are ordered by their text;
null doc_ids come last.  Very long texts only make their chunk longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, arrow_chunks, plain, rolling, sha_hex, whole

#: Words that make a repeat.
WIDTH = 20
#: Bytes of text in a chunk, and suffixes in a group, on average.
CHUNK = 8 << 20
GROUP = 1_500_000
#: Cells that beginnings of two words are counted in.
CELLS = 1 << 16


def _cells(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the full windows, and the cell of each one's two-word beginning."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    head = rolling(words.hash, min(2, width))
    return starts, (head[starts] >> np.uint64(48)).astype(np.int64)


def _histogram(docs: DataFrame, width: int) -> np.ndarray:
    """Suffixes in each cell, over all documents; CELLS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in arrow_chunks(batches, "text", CHUNK):
            total += np.bincount(_cells(Words(whole(part.column("text"))), width)[1], minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell."""
    base, parts = np.zeros(CELLS, np.int64), np.ones(CELLS, np.int64)
    group, load = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > GROUP:
            if load:
                group, load = group + 1, 0
            base[cell], parts[cell] = group, -(-n // GROUP)
            group += int(parts[cell])
            continue
        if load and load + n > GROUP:
            group, load = group + 1, 0
        base[cell] = group
        load += n
    return base, parts


class _Leaves:
    """The suffixes of a chunk, sorted by group and key."""

    def __init__(self, table: pa.Table, base: np.ndarray, parts: np.ndarray, width: int):
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = whole(table.column("doc_id"))
        self.words = Words(whole(table.column("text")))
        self.starts, cells = _cells(self.words, width)
        k1 = rolling(self.words.hash, width)[self.starts]
        k2 = (rolling(self.words.hash ^ np.uint64(0x5851F42D4C957F2D), width, seed=3)[self.starts] >> np.uint64(48)).astype(np.uint16)
        group = base[cells] + (k1 % parts[cells].astype(np.uint64)).astype(np.int64)
        self.order = np.lexsort((k2, k1, group))
        k1, k2, group = k1[self.order], k2[self.order], group[self.order]
        self.fresh = np.ones(len(k1), bool)
        self.fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (group[1:] != group[:-1])
        self.k1, self.k2, self.group = k1[self.fresh], k2[self.fresh], group[self.fresh]


def _pack(k1: np.ndarray, k2: np.ndarray) -> bytes:
    planes = [k1.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), k2.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    k1 = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return k1, np.ascontiguousarray(raw[8 * n :].reshape(2, n).T).view("<u2").ravel()


def _nodes(table: pa.Table) -> pa.Table:
    """Of one group: a bit for each key of each chunk, set where an earlier chunk has the key too."""
    chunks, sizes = table.column("chunk").to_pylist(), table.column("n").to_pylist()
    keys = [_unpack(b, n) for b, n in zip(table.column("keys").to_pylist(), sizes)]
    k1, k2 = np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys])
    chunk = np.repeat(np.array(chunks, np.int64), sizes)
    order = np.lexsort((chunk, k2, k1))
    a, b = k1[order], k2[order]
    later = np.zeros(len(a), bool)
    later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    flags = np.zeros(len(a), bool)
    flags[order] = later
    edges = np.concatenate([[0], np.cumsum(sizes)])
    bits = [zstandard.compress(np.packbits(flags[edges[i] : edges[i + 1]]).tobytes()) for i in range(len(sizes))]
    return pa.table({"chunk": table.column("chunk"), "g": table.column("g"), "bits": pa.array(bits, pa.binary())})


def _kept(leaves: _Leaves, repeats: np.ndarray, width: int, with_text: bool) -> dict:
    """Columns of a chunk's documents; ``repeats``: the distinct keys that an earlier chunk has."""
    words = leaves.words
    n = len(words.start)
    which = np.cumsum(leaves.fresh) - 1
    flagged = leaves.starts[leaves.order[~leaves.fresh | repeats[which]]] if len(which) else np.zeros(0, np.int64)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, flagged, 1)
    np.add.at(step, flagged + width, -1)
    keep = np.cumsum(step[:n]) == 0
    start, end = words.start[keep], words.end[keep]
    lens = end - start + 1
    stop = np.cumsum(lens)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - lens), lens)
    out = words.data[np.minimum(at, max(0, len(words.data) - 1))]
    out[stop - 1] = 32
    kept = np.concatenate([[0], np.cumsum(keep)])
    n_kept = kept[words.first[1:]] - kept[words.first[:-1]]
    ends = np.concatenate([[0], stop])[kept[words.first]]
    texts = [out[ends[i] : ends[i + 1] - 1].tobytes() if n_kept[i] else b"" for i in range(words.rows)]
    counts = np.diff(words.first)
    found = {"doc_id": leaves.ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(counts - n_kept, pa.int64()), "kept_sha256": pa.array([sha_hex(t) for t in texts], pa.string())}
    return found | ({"kept": pa.array([t.decode("utf-8") for t in texts], pa.string())} if with_text else {})


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row and, on request, the ``kept`` words.

    A word goes when a window of ``width`` words that covers it starts
    earlier too (smaller doc_id, or the same document and an earlier place).
    """
    spark = docs.sparkSession
    ship(spark)
    docs = plain(docs, "doc_id", "text")
    counts = _histogram(docs, width)
    base, parts = _packed(counts)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n_chunks = max(1, -(-n_bytes // CHUNK))
    marks = np.arange(1, n_chunks) / n_chunks
    bounds = docs.select(F.percentile_approx("doc_id", marks.tolist(), int(max(10_000, 20 * n_chunks)))).collect()[0][0] if n_chunks > 1 else None
    bounds = np.unique(np.array(bounds or [], np.int64))
    ids = docs.schema["doc_id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc_id")
            chunk = np.searchsorted(bounds, pc.fill_null(doc.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), "left")
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *b.columns], names=["chunk", "doc_id", "text"])

    chunked = docs.mapInArrow(dealt, f"chunk long, doc_id {ids}, text string")

    def leaves_of(table: pa.Table) -> pa.Table:
        x = _Leaves(table, base, parts, width)
        edge = np.flatnonzero(np.diff(x.group)) + 1
        cuts = np.concatenate([[0], edge, [len(x.group)]]) if len(x.group) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.table(
            {
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(spans), pa.int64()),
                "g": pa.array([int(x.group[a]) for a, _ in spans], pa.int64()),
                "n": pa.array([b - a for a, b in spans], pa.int64()),
                "keys": pa.array([_pack(x.k1[a:b], x.k2[a:b]) for a, b in spans], pa.binary()),
            }
        )

    leaves = chunked.groupBy("chunk").applyInArrow(leaves_of, "chunk long, g long, n long, keys binary")
    found = leaves.groupBy("g").applyInArrow(_nodes, "chunk long, g long, bits binary")
    kinds = f"doc_id {ids}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", table.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else []))})
        x = _Leaves(table, base, parts, width)
        repeats = np.zeros(len(x.group), bool)
        for g, bits in zip(answers.column("g").to_pylist(), answers.column("bits").to_pylist()):
            a, b = np.searchsorted(x.group, [g, g + 1])
            repeats[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8), count=int(b - a)).astype(bool)
        return pa.table(_kept(x, repeats, width, with_text))

    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, kinds)
