"""Operator 12: packing documents into windows by non-negative least squares.

A document's ids are cut at every ``window``-th one; what is left is its rest.
Rests are counted by length, and all combinations of at most ``depth`` lengths
(in steps of ``grain``) that fill a window are enumerated.  Non-negative least
squares against the histogram says how often each combination is used; rounded
down, these take most rests whole.  The residual is packed greedily, longest
first, each time with the longest that still fits; a gap of at least ``least``
ids that no rest fits is filled by cutting one.

The plan's size depends on the window alone (lengths, not documents), so it is
made on the driver and sent to all tasks.  Rests find their place in it by
their number among those of equal length: numbers within a task are given while
encoding and moved by what earlier tasks hold, so that a length that many
documents share is no hot key.

Null texts count as empty; every document ends with the id ``end``, so that
empty ones have one id.  Rows repeat as given, null keys are packed as others.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, stored
from .common import arrow_chunks, give_back, whole
from .merges import encoder
from .tokens import default_vocabulary

#: Ids a sequence, steps of length and rests a combination, and the smallest gap that a cut fills.
WINDOW, GRAIN, DEPTH, LEAST = 2048, 8, 4, 32
#: The id after each document.
END = 1
#: Bytes of text encoded together.
CHUNK = 2 << 20


# --- the plan ---------------------------------------------------------------


def combinations(total: int, depth: int) -> np.ndarray:
    """All ways to write ``total`` as at most ``depth`` whole numbers, largest first, padded by zeros."""
    rows = np.zeros((1, 0), np.int64)
    left, most = np.array([total]), np.array([total])
    for k in range(depth, 0, -1):
        low = -(-left // k)  # the rest must fit below this number
        count = np.maximum(0, np.minimum(most, left) - low + 1)
        take = np.repeat(np.arange(len(rows)), count)
        part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[take]
        rows, left, most = np.c_[rows[take], part], left[take] - part, part
    return rows


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Repeats x >= 0 of the combinations that least-squares fit ``histogram`` (index 0 unused): active sets after Lawson and Hanson."""
    n = len(histogram)
    scale = max(1.0, float(histogram.max(initial=0)))
    target = histogram / scale
    target[0] = 0.0
    held: list[int] = []
    matrix = np.zeros((n, 0))
    x = np.zeros(0)

    def column(k: int) -> np.ndarray:
        out = np.bincount(combos[k], minlength=n).astype(float)
        out[0] = 0.0
        return out

    for _ in range(rounds or 3 * n):
        gap = target - matrix @ x
        gap[0] = 0.0
        slope = gap[combos].sum(1)
        slope[held] = -1.0
        best = int(slope.argmax())
        if slope[best] < 1e-9:
            break
        held.append(best)
        matrix, x = np.c_[matrix, column(best)], np.append(x, 0.0)
        while True:
            free = np.linalg.lstsq(matrix, target, rcond=None)[0]
            if free.min() > 1e-12:
                x = free
                break
            low = np.flatnonzero(free <= 1e-12)
            step = float(np.min(x[low] / np.maximum(x[low] - free[low], 1e-300)))
            x = x + min(1.0, step) * (free - x)
            keep = x > 1e-12
            held = [h for h, k in zip(held, keep) if k]
            matrix, x = matrix[:, keep], x[keep]
            if not held:
                break
    out = np.zeros(len(combos))
    out[held] = x * scale
    return out


class _Stock:
    """Rests by length: pieces of equal length as runs (whole length, start, first number, count)."""

    def __init__(self, histogram: dict[int, int]):
        self.runs = {size: [(size, 0, 0, n)] for size, n in histogram.items() if n > 0}
        self.count = {size: n for size, n in histogram.items() if n > 0}

    def take(self, size: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.count[size] -= n
        while n:
            whole_, start, first, count = self.runs[size].pop()
            used = min(n, count)
            out.append((whole_, start, first, used))
            if used < count:
                self.runs[size].append((whole_, start, first + used, count - used))
            n -= used
        if not self.count[size]:
            del self.count[size], self.runs[size]
        return out

    def put(self, size: int, runs: list[tuple[int, int, int, int]]) -> None:
        self.runs.setdefault(size, []).extend(runs)
        self.count[size] = self.count.get(size, 0) + sum(r[3] for r in runs)


class Plan:
    """Where each rest goes: rows (whole length, start, first number, count, size, sequence, offset), the ``k``-th of a run to sequence + k."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, least: int = LEAST):
        if window % grain:
            raise ValueError("grain divides the window")
        self.window, self.least = window, least
        self.rows: list[tuple[int, ...]] = []
        self.sequences = histogram.get(window, 0)
        if self.sequences:
            self.rows.append((window, 0, 0, self.sequences, window, 0, 0))
        stock = _Stock({size: n for size, n in histogram.items() if size < window})
        if sum(stock.count.values()) > 1:
            self._fit(stock, grain, depth)
        self._greedy(stock)

    def _emit(self, slots: list[list[tuple[int, int, int, int, int]]]) -> None:
        """Lay equally long lists of runs (with piece sizes) side by side: one sequence for each number."""
        at = [[0, 0] for _ in slots]
        while at[0][0] < len(slots[0]):
            now = [slot[i] for slot, (i, _) in zip(slots, at)]
            n = min(run[3] - used for run, (_, used) in zip(now, at))
            offset = 0
            for k, (whole_, start, first, count, size) in enumerate(now):
                self.rows.append((whole_, start, first + at[k][1], n, size, self.sequences, offset))
                offset += size
                at[k] = [at[k][0] + 1, 0] if at[k][1] + n == count else [at[k][0], at[k][1] + n]
            self.sequences += n

    def _fit(self, stock: _Stock, grain: int, depth: int) -> None:
        bins = self.window // grain
        lengths: dict[int, list[int]] = {}
        for size in sorted(stock.count):
            lengths.setdefault(-(-size // grain), []).append(size)
        histogram = np.zeros(bins + 1)
        for b, sizes in lengths.items():
            histogram[b] = sum(stock.count[s] for s in sizes)
        combos = combinations(bins, depth)
        combos = combos[((histogram > 0)[combos] | (combos == 0)).all(1)]
        if not len(combos):
            return
        repeats = least_squares(combos, histogram)
        for k in np.argsort(-repeats, kind="stable"):
            parts = [int(b) for b in combos[k] if b]
            n = int(min(repeats[k] + 1e-6, *[sum(stock.count.get(s, 0) for s in lengths[b]) // parts.count(b) for b in parts]))
            if n < 1:
                break
            slots = []
            for b in parts:
                slot, need = [], n
                while need:
                    size = next(s for s in reversed(lengths[b]) if s in stock.count)
                    used = min(need, stock.count[size])
                    slot += [(*run, size) for run in stock.take(size, used)]
                    need -= used
                slots.append(slot)
            self._emit(slots)

    def _greedy(self, stock: _Stock) -> None:
        while stock.count:
            order = np.array(sorted(stock.count))
            left, parts = self.window, []
            used: dict[int, int] = {}
            high = len(order)
            while left and high:
                high = min(high, int(np.searchsorted(order, left, "right")))
                if not high:
                    break
                size = int(order[high - 1])
                n = min(left // size, stock.count[size])
                parts += [size] * n
                used[size] = n
                left -= n * size
                high -= 1
            reps = min(stock.count[s] // n for s, n in used.items())
            longer = [int(s) for s in order[::-1] if s >= left + self.least and stock.count[int(s)] > used.get(int(s), 0)][:1] if left >= self.least else []
            if longer:
                size = longer[0]
                reps = min(reps, stock.count[size] // (used.get(size, 0) + 1))
            slots = [[(*run, s) for run in stock.take(s, reps)] for s in parts]
            if longer:
                runs = stock.take(longer[0], reps)
                slots.append([(*run, left) for run in runs])
                stock.put(longer[0] - left, [(w, start + left, first, n) for w, start, first, n in runs])
            self._emit(slots)

    def arrays(self) -> dict[str, np.ndarray]:
        """Rows ordered by (whole length, start, first number) for binary search."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 7)
        return dict(zip(("whole", "start", "first", "count", "size", "sequence", "offset"), rows.T.copy()))

    def cut(self) -> list[int]:
        """Lengths of which some rests are cut."""
        return sorted({r[0] for r in self.rows if r[4] < r[0]})


def _kind(ids: int) -> str:
    """Type that holds ``ids`` different ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


# --- the tables -------------------------------------------------------------


def encoded(docs: DataFrame, text: str, key: str, window: int, end: int, vocabulary: str | None, with_windows: bool) -> DataFrame:
    """One row a piece: windows of a document, then its rest; ``task`` and ``number`` count the pieces of equal length in a task.

    Ids have two bytes where the vocabulary allows it. Windows, which are never
    cut, carry theirs only if asked to.
    """
    path = vocabulary or default_vocabulary()
    context = docs.sparkSession.sparkContext
    spec = context.broadcast(open(path, encoding="utf-8").read())
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    shape = T.StructType([T.StructField("key", kind)]).add("start", "long").add("length", "integer").add("crc", "long").add("tokens", "long")
    shape = shape.add("task", "integer").add("number", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, spec.value)
        kept = _kind(max(machine.width, end + 1))
        task = TaskContext.get().partitionId()
        met = np.zeros(window + 1, np.int64)
        for chunk in arrow_chunks(batches, "text", CHUNK):
            ids, size = machine(whole(chunk.column("text")))
            size = size + 1
            last = np.cumsum(size)
            full = np.full(last[-1] if len(last) else 0, end, np.uint32)
            inner = np.ones(len(full), bool)
            inner[last - 1] = False
            full[inner] = ids
            parts = -(-size // window)
            row = np.repeat(np.arange(len(size)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
            length = np.minimum(size[row] - start, window)
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            number = np.empty(len(row), np.int64)
            number[order] = np.arange(len(row)) - first
            number += met[length]
            met += np.bincount(length, minlength=window + 1)
            at = (last - size)[row] + start
            raw = full.astype("<u4").tobytes()
            view = memoryview(raw)
            pieces = [view[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + length).tolist())]
            short = memoryview(full.astype(kept).tobytes())
            wide = np.dtype(kept).itemsize
            held = [short[wide * a : wide * b] if with_windows or b - a < window else None for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    whole(chunk.column("key")).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length, pa.int32()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    pa.array(size[row]),
                    pa.array(np.full(len(row), task), pa.int32()),
                    pa.array(number),
                    pa.array(held, pa.binary()),
                ],
                names=shape.names,
            )
            give_back()

    return docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, shape)


def _keys(whole_: np.ndarray, start: np.ndarray, number: np.ndarray, window: int) -> np.ndarray:
    """One sortable number of (whole length, start, number)."""
    bits = 62 - ((window + 1) ** 2).bit_length()
    if len(number) and int(number.max()) >> bits:
        raise ValueError(f"more than 2**{bits} rests of one length")
    return (whole_ * (window + 1) + start) << bits | number


def places(plan: dict[str, np.ndarray], whole_: np.ndarray, number: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, plan row) of all pieces of the given rests: a chain of cuts is followed from start 0."""
    keys = _keys(plan["whole"], plan["start"], plan["first"], window)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    row, start = np.arange(len(whole_)), np.zeros(len(whole_), np.int64)
    while len(row):
        at = np.searchsorted(keys, _keys(whole_[row], start, number[row], window), "right") - 1
        rows.append(row)
        found.append(at)
        start = start + plan["size"][at]
        more = start < whole_[row]
        row, start = row[more], start[more]
    return np.concatenate(rows), np.concatenate(found)


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    grain: int = GRAIN,
    depth: int = DEPTH,
    least: int = LEAST,
    end: int = END,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row a piece: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless switched off, the ids.

    Only pieces of lengths that the plan cuts (or all, if ids are asked for)
    carry their ids past the encoding.
    """
    pieces = stored(encoded(docs, text, key, window, end, vocabulary, with_ids))
    held = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    made = Plan(histogram, window, grain, depth, least)
    plan = docs.sparkSession.sparkContext.broadcast(made.arrays())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    wanted = F.lit(True) if with_ids else F.col("length").isin(made.cut()) if made.cut() else F.lit(False)
    rests = pieces.withColumn("ids", F.when(wanted, F.col("ids"))) if with_ids or made.cut() else pieces.withColumn("ids", F.lit(None).cast("binary"))
    rests = rests.join(moved, ["task", "length"]).withColumn("number", F.col("number") + F.col("moved")).select("key", "start", "length", "crc", "tokens", "number", "ids")
    shape = T.StructType([T.StructField(key, docs.schema[key].dataType)]).add("start", "long").add("length", "long").add("ids_crc32", "long")
    shape = shape.add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")
    shape = shape.add("ids", T.ArrayType(T.IntegerType())) if with_ids else shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        for batch in batches:
            length = batch.column(2).to_numpy().astype(np.int64)
            row, at = places(rows, length, batch.column(5).to_numpy(), window)
            size, start = rows["size"][at], rows["start"][at]
            crc = batch.column(3).to_numpy()[row].copy()
            part = np.flatnonzero(size < length[row]).tolist()
            ids = batch.column(6)
            slices = {}
            for k in range(len(row)) if with_ids else part:
                raw = ids[int(row[k])].as_buffer()
                held = np.frombuffer(raw, f"<u{len(raw) // int(length[row[k]])}")
                slices[k] = held[int(start[k]) : int(start[k] + size[k])].astype("<u4")
            for k in part:
                crc[k] = zlib.crc32(slices[k].tobytes())
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(batch.column(1).to_numpy()[row] + start),
                pa.array(size),
                pa.array(crc),
                batch.column(4).take(pa.array(row)),
                pa.array(rows["sequence"][at] + batch.column(5).to_numpy()[row] - rows["first"][at]),
                pa.array(rows["offset"][at]),
            ]
            if with_ids:
                columns.append(pa.array([slices[k].astype(np.int32) for k in range(len(row))], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return rests.mapInArrow(run, shape)
