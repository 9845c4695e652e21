"""Operator 9: language-model scores by a hashed maximum-entropy model.

Tokens are words in lower case (A-Z only) and one end for each text.  Word
counts cover all training documents; words meet by a 64-bit hash, their length and their first
eight bytes.  Listed
words are the most frequent ones seen twice or more, at most HEAD (a bound on
what is broadcast); all others are one last class and are drawn from it by
their discounted counts.  What discounting takes off goes to the unknown word,
which is one outcome here as in the base: words seen once teach the classes
where unknown words stand.

The model factors a token into its class (words by rank of frequency, classes
of about equal mass) and the word in its class.  Both are soft-maxes over
hashed features of the two words before:

- class: the word before, the word before that (a skip), and both together;
- word in its class: the word before, and both words (n-grams seen in training).

Words beyond the listed ones are features all the same, by a hash of 30 bits,
and words of equal hash share their features' weights.  Weights start from
discounted counts and are moved by PASSES gradient updates, each over all
training tokens, and a share of 1 - BLEND of each probability is the words' own
frequency: counts of copied texts make contexts look surer than they are.
Normalisation is exact: outside of the n-grams that
were seen after a context the prior holds, so sums run over what was seen.

Gradients are distributed by context: contexts are dealt to shards by the
word before (where that is frequent, by both words), so that every feature of
an n-gram, and the normalisation of every context, belongs to one shard.  The
number of shards grows with the corpus and a shard's tables with its n-grams,
so the model grows with the input and is nowhere gathered.  A skip's weight is
one of its shard.

A chunk of texts sends each distinct (context, outcome) once to its shard,
with its training count, and gets its log-probability back: a text that a third
of all rows repeat is one set of events for each chunk.  Words that aren't
listed get their counts by the same way.  One exchange carries all of it and
is used twice.

Null texts count as empty and hold one end.  A null doc_id is neither learned
from nor held out.  Repeated rows are each learned from and scored.  Without
training documents every word has count 0 and the model's score is the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, arrow_chunks, frugal, mix64, plain, remainder, stored, whole

HEAD = 1 << 18
#: Classes of listed words; the words beyond them are one more.
CLASSES = 7
PASSES = 2
#: Tokens of one shard, on average, and bytes of text of one chunk.
SHARD = 1 << 19
CHUNK = 4 << 20
#: Share of a diagonal Newton step, and what damps it.
RATE = 0.5
DAMPING = 0.5
#: What discounting takes off a count at least.
LEAST_DISCOUNT = 0.1
#: Training tokens that the prior of a class counts for beside a word's own followers.
PRIOR = 40.0
#: Share of the features' model in a probability; the rest is the words' own frequencies.
BLEND = 0.7

_END = (0x1F83D9ABFB41BD6B, 0x2545F4914F6CDD1D)
_BEGIN = (1 << 31) - 1
#: Counts fall into this many bins for each doubling; whole bins are listed.
_BINS = 16


class Slots:
    """Positions of 64-bit hashes by open addressing, looked up in whole arrays."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        size = 1 << max(4, (4 * len(hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        at = (hashes & self.mask).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (size - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        left, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            s = self.slots[at]
            hit = (s >= 0) & (self.hashes[s] == h[left])
            out[left[hit]] = s[hit]
            on = (s >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & int(self.mask)
        return out


class Vocabulary:
    """Counts of the listed words by rank, their classes and priors, and how contexts are dealt to shards."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, shards: int, tokens: int, discount: float = 0.5):
        self.total, self.distinct, self.shards, self.discount = total, distinct, shards, discount
        order = np.lexsort((hashes, -counts))
        self.slots, self.counts = Slots(hashes[order]), counts[order]
        self.listed = len(counts)
        # the last class: what discounting takes off its words goes to the one unknown word
        self.rest = float(total - int(counts.sum()) + 1)
        self.unknown = discount * (distinct - self.listed) + 1.0
        mass = np.cumsum(self.counts) - self.counts / 2
        cls = np.minimum(mass * CLASSES / max(1, self.counts.sum()), CLASSES - 1).astype(np.int64)
        self.cls = np.concatenate([cls, [CLASSES]])
        size = np.bincount(self.cls[:-1], self.counts, CLASSES)
        self.prior = self.counts / np.maximum(1.0, size)[cls]
        size = np.concatenate([size, [self.rest]]) + 1e-3
        self.class_prior = size / size.sum()
        # a frequent word's contexts go to several shards, by the word before it
        parts = np.ceil(4.0 * self.counts * max(1.0, tokens / max(1, total)) / SHARD)
        self.parts = np.clip(parts, 1, shards).astype(np.int64)

    def rare(self, times: np.ndarray) -> np.ndarray:
        """log10 P(word | last class) of words seen so often, the unknown word at 0."""
        return np.log10(np.where(times > 0, times - self.discount, self.unknown) / self.rest)

    def shard(self, before: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        parts = np.ones(len(before), np.int64)
        known = before < self.listed
        parts[known] = self.parts[before[known]]
        home = mix64(before.astype(np.uint64) + np.uint64(11)) % np.uint64(self.shards)
        step = mix64(skipped.astype(np.uint64) + np.uint64(17)) % parts.astype(np.uint64)
        return ((home + step) % np.uint64(self.shards)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed planes of bytes."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    n = len(sorted_keys[0])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for k in sorted_keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)


def _lists(row: np.ndarray, index: np.ndarray, n: int) -> bytes:
    """For each row its indices in order, as differences."""
    flat = np.sort(row << np.int64(32) | index)
    step = flat & np.int64(0xFFFFFFFF)
    same = flat[1:] >> np.int64(32) == flat[:-1] >> np.int64(32)
    step[1:] -= np.where(same, step[:-1], 0)
    return _pack(np.bincount(row, minlength=n).astype("<i4")) + b"|" + _pack(step.astype("<i4"))


def _listed(data: bytes, n: int, sizes_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    (sizes,) = _unpack(data[:sizes_bytes], n, "<i4")
    total = int(sizes.sum())
    (step,) = _unpack(data[sizes_bytes + 1 :], total, "<i4")
    run = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    base = np.zeros(n, np.int64)
    some = sizes > 0
    base[some] = run[first[some]] - step[first[some]]
    row = np.repeat(np.arange(n), sizes)
    return row, run - base[row]


class Tokens:
    """Tokens of a batch of texts: hashes, row, listed rank (-1: not listed), and ids of the token and the two before."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        self.words = words = Words(texts, lower=True)
        n = words.rows
        place = np.arange(len(words.start)) + words.doc
        ends = words.first[1:] + np.arange(n)
        self.place = place
        self.hash = np.empty(len(words.start) + n, np.uint64)
        self.hash[place], self.hash[ends] = words.hash, np.uint64(_END[0])
        self.row = np.empty(len(self.hash), np.int64)
        self.row[place], self.row[ends] = words.doc, np.arange(n)
        self.rank = vocabulary.slots(self.hash)
        far = vocabulary.listed + (self.hash >> np.uint64(34)).astype(np.int64)
        self.ids = np.where(self.rank >= 0, self.rank, far)
        self.before, self.skipped = np.full(len(self.ids), _BEGIN, np.int64), np.full(len(self.ids), _BEGIN, np.int64)
        same = self.row[1:] == self.row[:-1]
        self.before[1:][same] = self.ids[:-1][same]
        same = self.row[2:] == self.row[:-2]
        self.skipped[2:][same] = self.ids[:-2][same]


def _discount(n: np.ndarray) -> float:
    """What absolute discounting takes off a count, from the numbers of features seen once and twice."""
    return _taken(int((n == 1).sum()), int((n == 2).sum()))


def _taken(once: int, twice: int) -> float:
    return min(0.95, max(LEAST_DISCOUNT, once / max(1, once + 2 * twice)))


def _start(count: np.ndarray, total: np.ndarray, prior: np.ndarray, discount: float, group: np.ndarray) -> np.ndarray:
    """Weights with which the discounted shares of a group, what is left going to the prior, come out."""
    share = np.maximum(count - discount, 0) / np.maximum(total, 1)[group]
    left = 1 - np.bincount(group, share, len(total))
    return np.log1p(share / np.maximum(left[group] * prior, 1e-12))


def _moved(weights: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, damping: float = DAMPING) -> None:
    weights += np.clip(RATE * gradient / (curvature + damping), -1, 1)


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of its run for each of n sorted entries."""
    out = np.zeros(n, np.int32)
    out[starts[1:]] = 1
    return np.cumsum(out, dtype=np.int32)


class Shard:
    """The model of the contexts of one shard: events (context, outcome) with training counts, sorted by context and outcome."""

    def __init__(self, before: np.ndarray, skipped: np.ndarray, outcome: np.ndarray, n: np.ndarray, v: Vocabulary):
        self.v = v
        both = before << np.int64(32) | skipped
        order = np.argsort(both)
        both = both[order]
        context = _spread(_runs(both), len(both)).astype(np.int64)
        inner = np.argsort(context << np.int64(32) | outcome[order])
        order = order[inner]  # sorting by context leaves ``both`` as it is
        o = outcome[order]
        cut = _runs(context, o)
        self.event = np.empty(len(order), np.int32)  # of each given row
        self.event[order] = _spread(cut, len(order))
        self.n = np.add.reduceat(n[order], cut).astype(float)
        self.o, self.ctx = o[cut], context[cut]
        both = both[_runs(context)]
        self.before, self.skipped = both >> np.int64(32), both & np.int64(0xFFFFFFFF)
        self.word = _spread(_runs(self.before), len(both))
        self.cls = v.cls[self.o]
        own = np.log(v.class_prior)[self.cls] + np.log(np.append(v.prior, 1.0))[self.o]
        self.log = np.logaddexp(self._classes() + self._words() + np.log(BLEND), own + np.log1p(-BLEND))

    def _classes(self) -> np.ndarray:
        """log P(class | context) of each event."""
        width, contexts = CLASSES + 1, len(self.before)
        cut = _runs(self.ctx, self.cls)
        ctx, cls = self.ctx[cut], self.cls[cut]
        n = np.add.reduceat(self.n, cut)
        total = np.bincount(ctx, n, contexts)
        prior, word = self.v.class_prior, self.word
        # the word before: its followers' classes over the prior; classes go down, contexts across
        words = int(word[-1]) + 1
        rows = np.bincount(cls * words + word[ctx], n, words * width).reshape(width, words)
        prior = prior[:, None]
        mass1 = rows.sum(axis=0)
        given = (rows + PRIOR * prior) / (mass1 + PRIOR)
        one = np.log(given / prior).astype(np.float32)
        curve1 = mass1 * given * (1 - given)
        discount, seen = _discount(n), n > 0
        two = _start(n, total, given[cls, word[ctx]], discount, ctx) * seen
        target2 = np.maximum(n - discount, 0)
        _, skip = np.unique(self.skipped, return_inverse=True)
        skips = int(skip.max()) + 1
        curve3 = np.bincount(skip, total, skips) * prior * (1 - prior)
        three = np.zeros((width, skips), np.float32)
        bias, mass = np.log(prior).astype(np.float32), total.astype(np.float32)
        out = np.empty(len(n), np.float32)
        step = 1 << 15
        edges = np.searchsorted(ctx, np.arange(0, contexts + step, step))
        for turn in range(PASSES + 1):
            train = turn < PASSES
            g1, g3 = np.zeros((width, words)), np.zeros((width, skips))
            for block, lo in enumerate(range(0, contexts, step)):
                hi, (a, b) = min(contexts, lo + step), edges[block : block + 2]
                w, k = word[lo:hi], skip[lo:hi]
                flat = cls[a:b] * (hi - lo) + ctx[a:b] - lo
                z = one[:, w[0] : w[-1] + 1].take(w - w[0], axis=1)
                z += three.take(k, axis=1)
                z += bias
                z.ravel()[flat] += two[a:b]
                np.exp(z, out=z)
                z /= z.sum(axis=0)
                out[a:b] = z.ravel()[flat]
                if train:
                    z *= -mass[lo:hi]
                    z.ravel()[flat] += n[a:b]
                    starts = _runs(w)
                    g1[:, w[starts]] += np.add.reduceat(z, starts, axis=1)
                    for c in range(width):
                        g3[c] += np.bincount(k, z[c], skips)
            if train:
                expected = total[ctx] * out
                _moved(two, (target2 - expected) * seen, expected * (1 - out))
                _moved(one, g1, curve1, 4 * DAMPING)
                _moved(three, g3, curve3, 20 * DAMPING)
        return np.log(np.maximum(out, 1e-30, dtype=float))[_spread(cut, len(self.n))]

    def _words(self) -> np.ndarray:
        """log P(word | class, context) of each event; 0 for the last class."""
        out = np.zeros(len(self.n))
        inner = np.flatnonzero(self.cls < CLASSES)
        if not len(inner):
            return out
        o, n, ctx, cls = self.o[inner], self.n[inner], self.ctx[inner], self.cls[inner]
        word = self.word[ctx].astype(np.int64)
        # features of the word before, in groups of (word before, class)
        key = word << np.int64(32) | o
        order = np.argsort(key)
        cut = _runs(key[order])
        pair = np.empty(len(o), np.int32)
        pair[order] = _spread(cut, len(o))
        first = order[cut]
        n1, prior = np.add.reduceat(n[order], cut), self.v.prior[o[first]]
        group_cut = _runs(word[first], cls[first])
        group = _spread(group_cut, len(cut))
        total1 = np.add.reduceat(n1, group_cut)
        d1, d2 = _discount(n1), _discount(n)
        seen1, seen2 = n1 > 0, n > 0
        one = _start(n1, total1, prior, d1, group) * seen1
        # features of both words, in groups of (context, class)
        own_cut = _runs(ctx, cls)
        own = _spread(own_cut, len(o))
        total2 = np.add.reduceat(n, own_cut)
        above, mass = group[pair[own_cut]], total2[own]
        target1, target2 = n1 - d1 * d2, np.maximum(n - d2, 0)
        two = None
        for turn in range(PASSES + 1):
            x1 = np.exp(one) * prior
            z1 = 1 + np.bincount(group, x1 - prior, len(total1))
            if two is None:
                two = _start(n, total2, (x1 / z1[group])[pair], d2, own) * seen2
            low = x1[pair]
            x2 = low * np.exp(two)
            z = np.maximum(z1[above] + np.bincount(own, x2 - low, len(total2)), 1e-12)
            z_own = z[own]
            p = x2 / z_own
            if turn == PASSES:
                break
            expected = mass * p
            _moved(two, (target2 - expected) * seen2, expected * (1 - p))
            expected = x1 * np.bincount(above, total2 / z, len(total1))[group] + np.bincount(pair, mass * (p - low / z_own), len(n1))
            _moved(one, (target1 - expected) * seen1, np.maximum(expected, 0))
        out[inner] = np.log(np.clip(p, 1e-30, 1))
        return out


def _counted(docs: DataFrame) -> DataFrame:
    """(h, h2, n) of all words of the given texts and the end; words meet in a shuffle after each chunk has summed its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_chunks(batches, "text", CHUNK):
            words = Words(whole(part.column("text")), lower=True)
            order = np.argsort(words.hash)
            h = words.hash[order]
            cut = _runs(h)
            n, h2 = np.diff(np.append(cut, len(h))), words.heads(order[cut])
            columns = np.append(h[cut], np.uint64(_END[0])).view(np.int64), np.append(h2, np.uint64(_END[1])).view(np.int64), np.append(n, words.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "h2", "n"])

    return docs.select("text").mapInArrow(run, "h long, h2 long, n long").groupBy("h", "h2").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, learned_share: float) -> tuple[Vocabulary, DataFrame]:
    """The listed words, and the counts of all others dealt to the shards by their second hash."""
    binned = counts.withColumn("bin", F.floor(F.log2(F.col("n").cast("double")) * _BINS).cast("int"))
    sizes = {r["bin"]: (r["words"], r["mass"]) for r in binned.groupBy("bin").agg(F.count("*").alias("words"), F.sum("n").alias("mass")).collect()}
    distinct, total = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    cut, held = max(sizes, default=0) + 1, 0
    for b in sorted(sizes, reverse=True):  # whole bins, so that the listed words don't depend on ties
        # words seen once stand for those not seen yet
        if b == 0 or held + sizes[b][0] > HEAD:
            break
        cut, held = b, held + sizes[b][0]
    head = binned.filter(F.col("bin") >= cut).select("h", "n").toArrow()
    tokens = int(total / max(learned_share, 0.05))
    shards = max(1, -(-tokens // SHARD))
    v = Vocabulary(head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy(), total, distinct, shards, tokens, _taken(*(sizes.get(b, (0, 0))[0] for b in (0, _BINS))))
    return v, binned.filter(F.col("bin") < cut).select(F.pmod("h2", F.lit(shards)).alias("key"), "h", "h2", "n")


_SENT = "key long, at long, n long, events binary, n_far long, far binary, sizes long"


def _scan(part: pa.Table, chunk: int, v: Vocabulary) -> pa.RecordBatch:
    """A chunk's blocks for the shards, and one row of its own with what is needed to add up its texts."""
    t = Tokens(whole(part.column("text")), v)
    n, doc = t.words.rows, whole(part.column("doc_id"))
    trained = np.asarray(whole(part.column("trained")).to_numpy(zero_copy_only=False), bool)
    outcome = np.where(t.rank >= 0, t.rank, v.listed)
    with np.errstate(over="ignore"):
        e = mix64(mix64(t.before.astype(np.uint64) << np.uint64(32) | t.skipped.astype(np.uint64)) + outcome.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(e)
    cut = _runs(e[order])
    index = np.empty(len(e), np.int64)
    index[order] = _spread(cut, len(e))
    count = np.add.reduceat(trained[t.row[order]].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)
    first = order[cut]
    before, skipped, outcome = t.before[first], t.skipped[first], outcome[first]
    shard = v.shard(before, skipped)
    sort = np.argsort(shard << np.int64(31) | before)
    place = np.empty(len(sort), np.int64)
    place[sort] = np.arange(len(sort))
    shard, before, skipped, outcome, count = (x[sort] for x in (shard, before, skipped, outcome, count))
    # words that aren't listed, each once
    far = np.flatnonzero(t.rank < 0)
    order = np.argsort(t.hash[far])
    h = t.hash[far][order]
    far_cut = _runs(h)
    far_index = np.empty(len(far), np.int64)
    far_index[order] = _spread(far_cut, len(far))
    h = h[far_cut]
    place_of = far[order][far_cut]
    real = h != np.uint64(_END[0])
    h2 = np.full(len(h), np.uint64(_END[1]))
    h2[real] = t.words.heads(place_of[real] - t.row[place_of[real]])
    far_sort = np.argsort(np.mod(h2.view(np.int64), v.shards), kind="stable")
    back = np.empty(len(h), np.int64)
    back[far_sort] = np.arange(len(h))
    h, h2, far_index = h[far_sort], h2[far_sort], back[far_index]
    far_shard = np.mod(h2.view(np.int64), v.shards)
    known = t.rank >= 0
    base = np.bincount(t.row[known], np.log10(v.counts[t.rank[known]] + 1.0), n)
    rows = []
    starts = _runs(shard)
    spans = {int(shard[a]): (a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)])}
    starts = _runs(far_shard)
    fars = {int(far_shard[a]): (a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h)])}
    for s in sorted(spans.keys() | fars.keys()):
        a, b = spans.get(s, (0, 0))
        c, d = fars.get(s, (0, 0))
        events = _pack(*(x.astype("<i4") for x in (np.diff(before[a:b], prepend=0), skipped[a:b], outcome[a:b], count[a:b])))
        rows.append((s, chunk, b - a, events, d - c, _pack(h[c:d], h2[c:d]), 0, None))
    stats = _pack(np.bincount(t.row, minlength=n), np.bincount(t.row[known], minlength=n), base)
    lists, far_lists = _lists(t.row, place[index], n), _lists(t.row[far], far_index, n)
    sizes = lambda row: len(_pack(np.bincount(row, minlength=n).astype("<i4")))
    head = np.array([len(stats), len(lists), sizes(t.row), sizes(t.row[far])], "<i8").tobytes()
    rows.append((-1 - chunk, chunk, n, head + stats + lists, 0, far_lists, 0, doc))
    names = [x.split()[0] for x in _SENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    lens = np.zeros(len(rows) + 1, np.int32)
    lens[-1] = n
    docs = pa.ListArray.from_arrays(pa.array(lens), doc, mask=pa.array([True] * (len(rows) - 1) + [False]))
    return pa.RecordBatch.from_arrays([*columns, docs], names=[*names, "docs"])


def _answers(sent: pa.Table, counts: pa.Table, v: Vocabulary) -> pa.Table:
    """A shard's model, and the log-probabilities and counts that the chunks asked for."""
    kinds = {"key": pa.int64(), "at": pa.int64(), "logs": pa.binary(), "n": pa.int64(), "far": pa.binary(), "n_far": pa.int64()}
    if not sent.num_rows or sent.column("key")[0].as_py() < 0:
        return pa.table({c: pa.array([], k) for c, k in kinds.items()})
    blocks = [_unpack(x, n, "<i4", "<i4", "<i4", "<i4") for x, n in zip(sent.column("events").to_pylist(), sent.column("n").to_pylist())]
    sizes = [len(b[0]) for b in blocks]
    logs = np.zeros(0, np.float32)
    if sum(sizes):
        before = np.concatenate([np.cumsum(b[0], dtype=np.int64) for b in blocks])
        skipped, outcome, n = (np.concatenate([b[i] for b in blocks]).astype(np.int64) for i in (1, 2, 3))
        model = Shard(before, skipped, outcome, n, v)
        logs = (model.log[model.event] / np.log(10.0)).astype("<f4")
    known = counts.combine_chunks().sort_by("h")
    kh, k2, kn = (np.append(known.column(c).to_numpy(), 0) for c in ("h", "h2", "n"))
    out_far = []
    for x, m in zip(sent.column("far").to_pylist(), sent.column("n_far").to_pylist()):
        h, h2 = _unpack(x, m, "<i8", "<i8")
        at = np.searchsorted(kh[:-1], h)
        # words whose first hashes are the same stand side by side
        n = np.zeros(m, np.int64)
        for _ in range(3):
            inside = np.minimum(at, len(kh) - 1)
            n = np.where((at < len(kh) - 1) & (kh[inside] == h) & (k2[inside] == h2), kn[inside], n)
            at = at + 1
        out_far.append(_pack(n))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    chunk = np.asarray(sent.column("at").to_numpy(), np.int64)
    rows = {
        "key": pa.array(-1 - chunk),
        "at": sent.column("key"),
        "logs": pa.array([_pack(logs[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
        "n": pa.array(sizes, pa.int64()),
        "far": pa.array(out_far, pa.binary()),
        "n_far": sent.column("n_far"),
    }
    return pa.table(rows)


def _added(sent: pa.Table, answers: pa.Table, v: Vocabulary) -> pa.Table:
    """Sums of a chunk's texts."""
    doc_type = sent.schema.field("docs").type.value_type
    if not sent.num_rows or sent.column("key")[0].as_py() >= 0:
        kinds = (doc_type, pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array([], k) for k in kinds], names=["doc_id", "n", "known", "weight", "logs"])
    answers = answers.sort_by("at")
    n, data, far_data = sent.column("n")[0].as_py(), sent.column("events")[0].as_py(), sent.column("far")[0].as_py()
    a, b, s1, s2 = np.frombuffer(data[:32], "<i8").tolist()
    tokens, known, weight = _unpack(data[32 : 32 + a], n, "<i8", "<i8", "<f8")
    row, index = _listed(data[32 + a : 32 + a + b], n, s1)
    none = [np.zeros(0)]
    logs = np.concatenate(none + [_unpack(x, m, "<f4")[0] for x, m in zip(answers.column("logs").to_pylist(), answers.column("n").to_pylist())])
    counts = np.concatenate(none + [_unpack(x, m, "<i8")[0] for x, m in zip(answers.column("far").to_pylist(), answers.column("n_far").to_pylist())])
    score = np.bincount(row, logs[index], n)
    row, index = _listed(far_data, n, s2)
    times = counts[index]
    extra = np.bincount(row, np.log10(times + 1.0), n)
    score += np.bincount(row, v.rare(times), n)
    known = known + np.bincount(row, times > 0, n).astype(np.int64)
    docs = sent.column("docs").combine_chunks().flatten()
    return pa.table([docs, pa.array(tokens), pa.array(known), pa.array(weight + extra), pa.array(score)], names=["doc_id", "n", "known", "weight", "logs"])


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from the rest."""
    ship(docs.sparkSession)
    docs = plain(docs, "doc_id", "text")
    kept_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    trained = F.col("doc_id").isNotNull() & ~kept_out
    counts = stored(_counted(docs.filter(trained)))
    vocabulary, far = _vocabulary(counts, (modulus - 1) / modulus)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ids = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in arrow_chunks(batches, "text", CHUNK):
            yield _scan(part, chunk, sent.value)
            chunk += 1

    blocks = docs.withColumn("trained", trained).mapInArrow(scan, f"{_SENT}, docs array<{ids}>")
    answers = blocks.groupBy("key").cogroup(far.groupBy("key")).applyInArrow(lambda a, b: frugal(_answers, a, b, sent.value), "key long, at long, logs binary, n long, far binary, n_far long")
    sums = blocks.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(lambda a, b: _added(a, b, sent.value), f"doc_id {ids}, n long, known long, weight double, logs double")
    total, floor = vocabulary.total, float(np.log10(vocabulary.total + 1.0 * (vocabulary.distinct + 1)))
    return sums.select(
        "doc_id",
        kept_out.alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("weight") - F.col("n") * floor).alias("base_score"),
        (F.col("logs") if vocabulary.listed else F.col("weight") - F.col("n") * floor).alias("score"),
    )
