"""Shared helpers: tables, the session's shared folder, and vectorised word scanning."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, stored

#: Code points that end a word: space and \x09-\x0D.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which has no such call
    _libc = None

_MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, modulus: int):
    """crc32(doc_id as text) mod ``modulus``, the fold a document belongs to (null ids: the text is null, remainder null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64: a bijection whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.empty(n, np.uint64)
        down = np.empty(n, np.uint64)
        up[:1] = down[:1] = 1
        up[1:] = _MULT
        down[1:] = np.uint64(pow(int(_MULT), -1, 1 << 64))
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i modulo 2**64 for i < n; long ones aren't kept."""
    up, down = _powers_to(1 << max(1, n - 1).bit_length()) if n <= 1 << 20 else _powers_to.__wrapped__(n)
    return up[:n], down[:n]


class Words:
    """The words of a batch of texts, scanned together.

    ``start``/``end`` are byte offsets of the words in ``data``, ``doc`` the
    row each belongs to, ``first`` the index of each row's first word (one
    entry more than rows), ``hash`` a 64-bit hash of each word's bytes.
    Null texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        base, stop = int(offsets[0]), int(offsets[-1])
        buffer = texts.buffers()[2]
        raw = np.frombuffer(buffer, np.uint8)[base:stop] if buffer is not None and stop > base else np.zeros(0, np.uint8)
        bounds = offsets - base
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        self.data, self.bounds, self.rows = raw, bounds, n
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edge = bounds[:-1][bounds[:-1] < len(raw)]
        begins[edge] = solid[edge]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        last = bounds[1:]
        last = last[last > 0] - 1
        closes[last] = solid[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = self._hashes() if hashed else None

    def _hashes(self) -> np.ndarray:
        """Polynomial prefix sums give each word's hash by one difference; blocks bound the memory."""
        out = np.empty(len(self.start), np.uint64)
        step = 1 << 18
        lo = 0
        while lo < len(self.start):
            hi = int(np.searchsorted(self.start, self.start[lo] + step, "right"))
            a, b = int(self.start[lo]), int(self.end[hi - 1])
            up, down = _powers(b - a)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data[a:b].astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
                s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
                out[lo:hi] = mix64((total[e] - total[s]) * down[s])
            lo = hi
        return out

    def heads(self, index: np.ndarray) -> np.ndarray:
        """First eight bytes and length of the given words, mixed: tells words of equal ``hash`` apart."""
        start, size = self.start[index], self.end[index] - self.start[index]
        out = np.zeros(len(index), np.uint64)
        for k in range(8):
            some = size > k
            out[some] |= self.data[start[some] + k].astype(np.uint64) << np.uint64(8 * k)
        return mix64(mix64(out) + size.astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def rolling(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each ``width`` consecutive entries of ``h`` (order matters); empty when too few.

    Runs over document ends; callers keep the positions whose run lies in one document.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= _MULT
            out += h[k : k + n]
    return mix64(out)


def give_back() -> None:
    """Return freed memory of this Python worker to the system; idle workers hold little afterwards."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def frugal(f: Callable, *args):
    """``f(*args)``, after which freed memory is given back."""
    try:
        return f(*args)
    finally:
        give_back()


def arrow_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Gather batches until ``limit`` bytes of ``column``: the unit of local work; a single longer text is a unit of its own.

    After the last one, freed memory is given back.
    """
    try:
        yield from _chunks(batches, column, limit)
    finally:
        give_back()


def _chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        nbytes = batch.column(batch.schema.get_field_index(column)).nbytes
        if nbytes > limit and batch.num_rows > 1:
            if held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            parts = min(batch.num_rows, -(-nbytes // limit))
            step = -(-batch.num_rows // parts)
            for at in range(0, batch.num_rows, step):
                yield pa.Table.from_batches([batch.slice(at, step)])
            continue
        if held and size + nbytes > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += nbytes
    if held:
        yield pa.Table.from_batches(held)


def whole(column: pa.ChunkedArray) -> pa.Array:
    """One array of a chunked column."""
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def plain(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of ``docs``, others dropped, so that extra columns can't clash."""
    return docs.select(*[F.col(f"`{c}`") for c in keep])


def mapped(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: dict[str, str]) -> DataFrame:
    """Every row with columns added by Python, one Arrow batch at a time; no shuffle.

    ``make()`` is called once per task and returns the function from a batch
    to the added columns (or to new values of present ones, which keep their
    place).  Present columns named like added ones are replaced.
    """
    ship(docs.sparkSession)
    rest = [f for f in docs.schema.fields if f.name not in added]
    shape = T.StructType([*rest, *[T.StructField(c, T._parse_datatype_string(k)) for c, k in added.items()]])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or make()
            new = each(batch)
            columns = [new.get(c, batch.column(i)) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, *[new[c] for c in added]], names=[*names, *added])
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, shape)


class Logistic:
    """A logistic curve over standardised features, fitted on the driver from a bounded sample by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        x, y = np.asarray(x, float), np.asarray(y, float)
        x = x if x.ndim == 2 else x.reshape(len(y), -1)
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(0) + 1e-9 if len(x) else np.ones(x.shape[1])
        z = self._lift(x)
        w = np.zeros(z.shape[1])
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        w[-1] = np.log(rate / (1 - rate))
        if 0 < y.sum() < len(y):
            damp = np.full(len(w), ridge)
            damp[-1] = 1e-6
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(damp + 1e-6), z.T @ (p - y) + damp * w)
                w -= np.clip(step, -5, 5)
                if np.abs(step).max() < 1e-8:
                    break
        self.weights = w
        p = np.clip(self(x), 1e-9, 1 - 1e-9)
        self.loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.mean))
        return 1 / (1 + np.exp(-np.clip(self._lift(x) @ self.weights, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int) -> DataFrame:
    """Texts of at most ``bound`` labelled training documents, chosen by a hash of doc_id: (doc_id, text, label).

    Rows without a label, and those whose fold ``held`` keeps apart, are left
    out.  Only the ids travel (the bound is their proven size); equal texts
    count once, as the one of the smallest doc_id and label.  The result is
    written to the shared folder.
    """
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(remainder("doc_id", modulus) != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("first"))
    return stored(rows.select("first.doc_id", "text", "first.label"))
