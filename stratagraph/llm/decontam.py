"""Operator 1: benchmark decontamination.

Texts and items become weighted shingles of ``k`` words; a shingle weighs more
the fewer items have it.  Item-sized windows of a text are fingerprinted by
SimHash and looked up in a multi-index: the fingerprint's bits are cut into
``radius + 1`` blocks, and two fingerprints within the radius agree in one
block at least, so the lookup misses none of them.  Candidates are verified by
the exact weighted Jaccard similarity of the shingle sets.

Only windows that could pass the verification are fingerprinted: a window
with similarity s holds at least s times the item's weight in item shingles,
which bounds their number from below.

A text shorter than an item is one window as a whole.

The items are sent to the executors in blocks of at most ITEM_BYTES, one pass
over the texts for each block; with several blocks, the shingles that items
share are counted over all of them first and sent along.  Of the texts,
nothing is shuffled but the found pairs.
Case doesn't count. Null or empty texts and items match nothing; items shorter than ``k`` words
are one shingle of all their words; repeated items and rows match each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from .common import Words, arrow_chunks, plain, rolling, whole

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Hamming radius of 64 bits; windows of similarity 0.8 differ in 10 bits on average, by 3 either way.
RADIUS = 20
#: Bytes of item texts in one broadcast block.
ITEM_BYTES = 16 << 20
CHUNK = 8 << 20

_BITS = 64


def _words(texts: pa.Array) -> Words:
    """Words in lower case, accented letters too."""
    return Words(pc.utf8_lower(texts))


def _fingerprint_sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums over positions of +-weight for each bit; one row more than positions."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    signed = np.where(bits, weights[:, None], -weights[:, None])
    return np.concatenate([np.zeros((1, _BITS)), np.cumsum(signed, axis=0)])


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class _Weights:
    """Weights of shingles by the number of all items that have them; ``keys`` (sorted) are those of two items or more."""

    def __init__(self, n: int, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.values = keys, np.log1p(n / counts)

    def get(self, x: int, default: float) -> float:
        at = int(np.searchsorted(self.keys, np.uint64(x)))
        return float(self.values[at]) if at < len(self.keys) and int(self.keys[at]) == x else default


class Index:
    """Items of one block: their shingles with weights, fingerprints and, for each size, the multi-index.

    ``shared`` holds the number of all items and the shingles of two or more
    of them with their counts; without it the block is all items.
    """

    def __init__(self, ids: list, texts: list[str | None], k: int, min_similarity: float, radius: int, shared: tuple | None = None):
        self.k, self.least, self.radius = k, min_similarity, radius
        words = _words(pa.array([t or "" for t in texts], pa.large_string()))
        self.ids, self.sizes, shingles = [], [], []
        for i, item in enumerate(ids):
            h = words.hash[words.first[i] : words.first[i + 1]]
            if len(h):
                self.ids.append(item)
                self.sizes.append(len(h))
                shingles.append(rolling(h, min(k, len(h))))
        n = shared[0] if shared else len(self.ids)
        if shared:
            self.weight = _Weights(*shared)
        else:
            frequency: dict[int, set[int]] = defaultdict(set)
            for i, s in enumerate(shingles):
                for x in s.tolist():
                    frequency[x].add(i)
            self.weight = {x: math.log1p(n / len(v)) for x, v in frequency.items()}
        self.unknown = math.log1p(max(1, n))  # the weight of shingles that one item has, too
        self.sets = [frozenset(s.tolist()) for s in shingles]
        self.blocks = [np.uint64(b) for b in np.linspace(0, _BITS, radius + 2).astype(int)]
        self.by_size: dict[int, dict] = {}
        for i, s in enumerate(shingles):
            w = np.array([self.weight.get(x, self.unknown) for x in s.tolist()])
            mark = int(_pack(_fingerprint_sums(s, w)[-1:])[0])
            size = self.by_size.setdefault(self.sizes[i], {"tables": defaultdict(list), "need": math.inf, "marks": {}})
            size["marks"][i] = mark
            size["need"] = min(size["need"], math.ceil(min_similarity * sum(self.weight.get(x, self.unknown) for x in self.sets[i]) / self.unknown - 1e-9))
            for b in range(radius + 1):
                size["tables"][b, self._block(mark, b)].append(i)
        # shingles by width (items shorter than k have a narrower one), with the sizes of the items that have them
        self.known: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        width_of: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, s in enumerate(self.sets):
            for x in s:
                width_of[min(k, self.sizes[i])][x].add(self.sizes[i])
        for width, found in width_of.items():
            keys = np.array(sorted(found), np.uint64)
            self.known[width] = keys, [sorted(found[x]) for x in keys.tolist()]

    def _block(self, mark: int, b: int) -> int:
        lo, hi = int(self.blocks[b]), int(self.blocks[b + 1])
        return (mark >> lo) & ((1 << (hi - lo)) - 1)

    def candidates(self, size: int, mark: int) -> set[int]:
        """Items of a size whose fingerprints are within the radius of ``mark``."""
        group = self.by_size[size]
        met = {i for b in range(self.radius + 1) for i in group["tables"].get((b, self._block(mark, b)), ())}
        return {i for i in met if (group["marks"][i] ^ mark).bit_count() <= self.radius}

    def similarity(self, item: int, shingles: frozenset) -> float:
        own = self.sets[item]
        weigh = lambda xs: sum(self.weight.get(x, self.unknown) for x in xs)
        return weigh(own & shingles) / weigh(own | shingles)

    def search(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, end word, similarity) of the passages found; overlapping windows count as their best one."""
        out = []
        for width, (keys, sizes) in self.known.items():
            shingle = rolling(words.hash, width)
            if not len(shingle):
                continue
            same = words.doc[: len(shingle)] == words.doc[width - 1 :]
            spots = np.zeros(1 << 16, bool)
            spots[(keys >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(spots[(shingle >> np.uint64(48)).astype(np.int64)] & same)
            at = np.minimum(np.searchsorted(keys, shingle[maybe]), len(keys) - 1)
            hit = keys[at] == shingle[maybe]
            places: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, s in zip(maybe[hit].tolist(), at[hit].tolist()):
                for size in sizes[s]:
                    places[int(words.doc[p]), size].append(p)
            for (row, size), found in places.items():
                out += self._windows(words, shingle, row, size, width, np.array(found))
        return out

    def _windows(self, words: Words, shingle: np.ndarray, row: int, size: int, width: int, found: np.ndarray) -> list:
        first, stop = int(words.first[row]), int(words.first[row + 1])
        inside = size - width  # a window's shingles start at its first word up to this many later
        need = max(1, self.by_size[size]["need"])
        if first + size > stop:
            return self._entire(shingle[first : stop - width + 1], row, size, stop - first) if len(found) >= need else []
        # starts from which a window holds enough item shingles
        opens = np.unique(np.concatenate([found - d for d in range(inside + 1)])) if inside < 64 else np.arange(found[0] - inside, found[-1] + 1)
        opens = opens[(opens >= first) & (opens + size <= stop)]
        opens = opens[np.searchsorted(found, opens + inside, "right") - np.searchsorted(found, opens, "left") >= need]
        best: dict[int, list] = {}
        out = []
        for lo, hi in _runs(opens):
            part = shingle[lo : hi + inside + 1]
            weights = np.array([self.weight.get(x, self.unknown) for x in part.tolist()])
            sums = _fingerprint_sums(part, weights)
            marks = _pack(sums[inside + 1 :] - sums[: hi - lo + 1])
            for i, mark in enumerate(marks.tolist()):
                met = self.candidates(size, mark)
                if not met:
                    continue
                inner = frozenset(part[i : i + inside + 1].tolist())
                for item in met:
                    s = self.similarity(item, inner)
                    if s >= self.least - 1e-12:
                        at = lo + i - first
                        last = best.get(item)
                        if last and at < last[3]:
                            if s > last[4]:
                                last[2:] = [at, at + size, s]
                        else:
                            if last:
                                out.append(tuple(last))
                            best[item] = [row, item, at, at + size, s]
        return out + [tuple(x) for x in best.values()]

    def _entire(self, part: np.ndarray, row: int, size: int, words: int) -> list:
        """Items of which a shorter text, as one window, is a near copy."""
        weights = np.array([self.weight.get(x, self.unknown) for x in part.tolist()])
        inner = frozenset(part.tolist())
        scored = [(item, self.similarity(item, inner)) for item in self.candidates(size, int(_pack(_fingerprint_sums(part, weights)[-1:])[0]))]
        return [(row, item, 0, words, s) for item, s in scored if s >= self.least - 1e-12]


def _shared(items: DataFrame, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of items with words, and the shingles that two or more of them have with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_chunks(batches, "text", CHUNK):
            words = _words(whole(part.column("text")))
            hashes = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:]) if b > a]
            found = [np.unique(rolling(h, min(k, len(h)))) for h in hashes]
            # the null shingle counts the items
            data = [pa.array(np.concatenate(found).view(np.int64)), pa.nulls(len(found), pa.int64())] if found else [pa.array([], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(data)], names=["shingle"])

    counts = items.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or shingle is null")
    t = counts.toArrow()  # grows with the shingles that items share
    none = t.column("shingle").is_null()
    n = pc.sum(t.filter(none).column("n")).as_py() or 0
    t = t.filter(pc.invert(none))
    keys, n_items = t.column("shingle").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(keys)
    return n, keys[order], n_items[order]


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive integers."""
    if not len(sorted_values):
        return []
    cut = np.flatnonzero(np.diff(sorted_values) != 1)
    return list(zip(sorted_values[np.concatenate([[0], cut + 1])].tolist(), sorted_values[np.concatenate([cut, [len(sorted_values) - 1]])].tolist()))


def find_passages(docs: DataFrame, items: DataFrame, k: int = SHINGLE, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, similarity): every passage of ``docs`` that is an item of ``items``; ids are of any type."""
    spark = docs.sparkSession
    ship(spark)
    items = plain(items, "item_id", "text")
    docs = plain(docs, "doc_id", "text")
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_word long, end_word long, similarity double"
    kind = to_arrow_type(items.schema["item_id"].dataType)
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).collect()[0][0] or 0
    n_blocks = max(1, -(-total // ITEM_BYTES))
    shared = spark.sparkContext.broadcast(_shared(items, k) if n_blocks > 1 else None)
    found = None
    for block in range(n_blocks):
        mine = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        rows = mine.orderBy("item_id", "text").collect()  # one block: ITEM_BYTES on average
        held = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = None
            for part in arrow_chunks(batches, "text", CHUNK):
                index = index or Index(*held.value, k, min_similarity, radius, shared.value)
                hits = index.search(_words(whole(part.column("text"))))
                ids = whole(part.column("doc_id"))
                row, item, a, b, s = zip(*hits) if hits else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in item], kind), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "start_word", "end_word", "similarity"])

        part = docs.mapInArrow(run, shape)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any passage of ``items``; columns as they are.

    The ids of contaminated documents are joined back by an anti join; rows
    with a null doc_id stay.
    """
    dirty = find_passages(docs, items, **options).filter("doc_id is not null").select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
