"""Operator 11: collocations from word-id suffix arrays.

Each task cuts its documents into shards.  The words of a shard get dense ids,
a suffix array over them is built by prefix doubling to the longest phrase's
depth, and its LCP intervals are the shard's phrases with their counts: an
interval of depth n holds all places of one n-word phrase.  Counts of all shards
are then summed by (language, phrase), so that a phrase that stands everywhere
is one row a shard.

A phrase is as frequent as asked only if all phrases inside it are.  So the
shards are gone through three times, for words, pairs and longer phrases, and
what is already known to be too rare ends a piece.  What is frequent is sent to
the tasks as a bit filter of bounded size: a false hit costs a row, never a
count, since the sums decide.

Null texts count as empty, null languages as ``und``.  Rows repeat as given and
count each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from .common import arrow_chunks, give_back, mix64, whole
from .merges import _gather, _Strings

#: Bytes of text in a shard.
SHARD = 3 << 20
#: Bits a frequent phrase has in the filter, and the least and most bits of a filter (32 MB).
SPREAD, FEWEST, MOST = 16, 1 << 16, 1 << 28
#: Bits gathered together while a filter is made.
BLOCK = 1 << 16
#: Parts of a language's phrases that are ranked before the last ranking.
PARTS = 64

_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True


class Filter:
    """A set of (language, phrase) that may hold some too many, never one too few."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def spots(langs: _Strings, lang: np.ndarray, phrases: _Strings, size: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix64(phrases.hashes() + langs.hashes()[lang] * np.uint64(0x9E3779B97F4A7C15))
        mask = np.uint64(size - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)

    def __call__(self, langs: _Strings, lang: np.ndarray, phrases: _Strings) -> np.ndarray:
        a, b = self.spots(langs, lang, phrases, 8 * len(self.bits))
        hit = [(self.bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 for s in (a, b)]
        return (hit[0] & hit[1]).astype(bool)

    @classmethod
    def of(cls, frequent: DataFrame) -> Filter:
        """Bits of all rows (lang, phrase), set on the executors; at most ``MOST`` of them reach the driver."""
        size = max(FEWEST, min(MOST, 1 << (SPREAD * max(1, frequent.count())).bit_length()))

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, phrases = (batch.column(k).cast(pa.large_binary()) for k in (0, 1))
                at = np.concatenate(cls.spots(_Strings.of(langs), np.arange(len(langs)), _Strings.of(phrases), size))
                yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32))], names=["block", "spot"])

        def packed(key, rows):
            bits = np.zeros(BLOCK, np.uint8)
            bits[rows["spot"].to_numpy()] = 1
            rows = rows.iloc[:1][["block"]]
            return rows.assign(bits=[np.packbits(bits, bitorder="little").tobytes()])

        spots = frequent.select("lang", "phrase").mapInArrow(positions, "block int, spot int").distinct()
        out = np.zeros(size // 8, np.uint8)
        for r in spots.groupBy("block").applyInPandas(packed, "block int, bits binary").collect():
            out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
        return cls(out)


def _rows(phrases: pa.Array, langs: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    """(key, count), the key being phrase and language on two lines: one short string to shuffle."""
    keys = pc.binary_join_element_wise(phrases, langs, "\n")
    return pa.RecordBatch.from_arrays([keys, pa.array(count.astype(np.int64))], names=["key", "count"])


class Shard:
    """Words of some documents, laid end to end with one space after each.

    ``ids`` are dense over (language, word); ``head`` marks the first word of a piece.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_binary())
        rows = _Strings.of(texts)
        raw, bounds = np.append(rows.data, np.uint8(32)), rows.bounds
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        ends = _ENDS[raw]
        solid = ~(ends | (raw == 32) | (raw == 9))
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edge = bounds[:-1]
        begins[edge] = solid[edge]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        last = bounds[1:][bounds[1:] > 0] - 1
        closes[last] = solid[last]
        start = np.flatnonzero(begins)
        size = np.flatnonzero(closes) + 1 - start
        passed = np.cumsum(ends, dtype=np.int32)[start]
        doc = np.searchsorted(bounds, start, "right") - 1
        self.head = np.ones(len(start), bool)
        self.head[1:] = (np.diff(passed) != 0) | (np.diff(doc) != 0)
        self.text = _gather(raw, start, size + 1)
        self.bounds = np.concatenate([[0], np.cumsum(size + 1)])
        self.text[self.bounds[1:] - 1] = 32
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(self.bounds), pa.py_buffer(self.text)]).dictionary_encode()
        tongues = langs.cast(pa.large_binary()).dictionary_encode()
        self.langs = _Strings.of(tongues.dictionary)
        self.lang_names = tongues.dictionary.cast(pa.large_string()).cast(pa.string())
        self.lang = tongues.indices.to_numpy()[doc].astype(np.int64)
        self.ids = coded.indices.to_numpy().astype(np.int64) * len(self.lang_names) + self.lang
        self._words = np.arange(len(start))

    def only(self, keep: np.ndarray) -> None:
        """Drop the other words, each of which ends a piece."""
        self._words = self._words[keep]
        self.head = self.head[keep] | (np.diff(self._words, prepend=-2) != 1)
        self.ids, self.lang = self.ids[keep], self.lang[keep]

    def left(self) -> np.ndarray:
        """Words from each place to its piece's end, itself included."""
        heads = np.append(np.flatnonzero(self.head), len(self.ids))
        return np.repeat(heads[1:], np.diff(heads)) - np.arange(len(self.ids))

    def strings(self, at: np.ndarray, n: int) -> _Strings:
        """The ``n`` words from each place, joined by single spaces."""
        word = self._words[at]
        lo, hi = self.bounds[word], self.bounds[word + n] - 1
        return _Strings(_gather(self.text, lo, hi - lo), np.concatenate([[0], np.cumsum(hi - lo)]))

    def batch(self, at: np.ndarray, n: int, count: np.ndarray) -> pa.RecordBatch:
        held = self.strings(at, n)
        phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(held.bounds), pa.py_buffer(held.data)])
        return _rows(phrases.cast(pa.large_string()).cast(pa.string()), self.lang_names.take(pa.array(self.lang[at])), count)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """All places in order of the next ``depth`` ids of their pieces, by prefix doubling; shorter pieces come first."""
    rank, reach = ids + 1, 1
    order = np.argsort(rank, kind="stable")
    while reach < depth and len(ids):
        after = np.zeros(len(ids), np.int64)
        far = np.flatnonzero(left > reach)
        after[far] = rank[far + reach]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        reach *= 2
    return order


def common(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """LCP of each place in ``order`` with the one before it, as far as ``depth``; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[open_ - 1], order[open_]
        open_ = open_[(left[a] > k) & (left[b] > k)]
        a, b = order[open_ - 1] + k, order[open_] + k
        open_ = open_[ids[a] == ids[b]]
        lcp[open_] = k + 1
    return lcp


def intervals(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of ``n`` words: one place of each, its count, and the interval that each entry of ``order`` lies in (-1: none)."""
    new = lcp < n
    number = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    some = left[order[heads]] >= n
    place = np.where(some, np.cumsum(some) - 1, -1)
    count = np.diff(np.append(heads, len(order)))
    return order[heads[some]], count[some], place[number] if len(order) else number


def _counted(docs: DataFrame, least: int, lengths: tuple[int, ...], words: Filter | None, pairs: Filter | None) -> DataFrame:
    """(lang, phrase, n, f) of phrases of the given lengths with f >= ``least``; length 0 stands for all words together."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((words.bits if words else None, pairs.bits if pairs else None))

    def each(shard: Shard) -> Iterator[pa.RecordBatch]:
        words_, pairs_ = (Filter(b) if b is not None else None for b in sent.value)
        if not len(shard.ids):
            return
        if 0 in lengths:
            total = np.bincount(shard.lang, minlength=len(shard.lang_names))
            yield _rows(pa.array([""] * len(total), pa.string()), shard.lang_names, total)
        if words_:
            one, place = np.unique(shard.ids, return_index=True)
            kept = one[words_(shard.langs, shard.lang[place], shard.strings(place, 1))]
            at = np.minimum(np.searchsorted(kept, shard.ids), max(0, len(kept) - 1))
            shard.only(kept[at] == shard.ids if len(kept) else np.zeros(len(shard.ids), bool))
        if pairs_ and len(shard.ids):
            left = shard.left()
            order = suffix_array(shard.ids, left, 2)
            place, _, inside = intervals(order, common(shard.ids, left, order, 2), left, 2)
            good = np.append(pairs_(shard.langs, shard.lang[place], shard.strings(place, 2)), False)[inside]
            linked = np.zeros(len(shard.ids), bool)
            linked[order[good]] = True  # the pair that starts here is frequent
            shard.head[1:] |= ~linked[:-1]
            far = shard.left()
            long = np.concatenate([[False, False], far >= 3])
            shard.only(long[2:] | long[1:-1] | long[:-2])  # what no phrase of three words covers isn't needed any more
        left = shard.left()
        depth = max(lengths)
        order = suffix_array(shard.ids, left, depth)
        lcp = common(shard.ids, left, order, depth)
        for n in lengths:
            if n:
                place, count, _ = intervals(order, lcp, left, n)
                yield shard.batch(place, n, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrow_chunks(batches, "text", SHARD):
            yield from each(Shard(whole(chunk.column("text")), whole(chunk.column("lang"))))
            give_back()

    sums = docs.mapInArrow(run, "key string, count bigint").groupBy("key").agg(F.sum("count").alias("f"))
    phrase = F.substring_index("key", "\n", 1)  # no phrase holds a line end
    sums = sums.filter((F.col("f") >= least) | (phrase == ""))
    words_in = F.when(phrase == "", F.lit(0)).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)
    return sums.select(F.expr("substring(key, locate('\n', key) + 1)").alias("lang"), phrase.alias("phrase"), words_in.alias("n"), "f")


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4) -> DataFrame:
    """(lang, phrase, n, f): all phrases of at most ``longest`` words with f >= ``least``, and a row of n = 0 with all words of a language."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more, and are counted at least once")
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    words = stored(_counted(docs, least, (0, 1), None, None))
    known = Filter.of(words.filter("n = 1"))
    pairs = stored(_counted(docs, least, (2,), known, None))
    if longest == 2:
        return words.union(pairs)
    more = _counted(docs, least, tuple(range(3, longest + 1)), known, Filter.of(pairs))
    return words.union(pairs).union(stored(more))


def _wide(c: str):
    return F.col(c).cast("decimal(19,0)")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    The score of a phrase is its worst cut's floor(2000000 a / (l + r)).  A phrase
    is left out if a longer one that holds it has ``covered`` percent of its
    count or more.  Products are taken in 38 decimal digits.
    """
    found = frequent(docs, text, lang, least, longest)
    phrases = found.filter("n >= 2").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"))
    parts = found.filter("n >= 1")
    cuts = phrases.filter(F.col("size") >= 2).select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("second", F.expr("substring_index(phrase, ' ', k - size)"))
    for part, name in (("first", "l"), ("second", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.select("*", score.cast("bigint").alias("score")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    best = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    held = phrases.filter("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * _wide("longer") < F.lit(covered) * _wide("a"), F.lit(True)))
    by = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*by)
    kept = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("bigint")).filter(F.col("rank") <= top)
    totals = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
