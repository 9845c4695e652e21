"""Operator 13: fill-in-middle transformation over a sparse checkpoint index.

While the units of a text (code points, words or lines) are counted, the byte
and unit offsets of every ``STEP``-th unit are recorded.  A cut is found by a
binary search among these checkpoints and a short rescan from the one before
it.  Counting runs over strips of fixed size, so a text needs no table of all
its units.  Nothing is shuffled; each text is one row in and one row out.

Null texts count as empty; empty texts, and texts that hold one of the marks,
stay as they are (``plain``).  A null id is hashed as an empty one.  Rows repeat
as given: equal ids and texts give equal rows.  Added columns of the same names
are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Units between two checkpoints, and bytes that are counted at once.
STEP, STRIP = 1024, 1 << 16
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")


def _starts(data: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Byte offsets in [lo, hi) at which a unit starts."""
    part = data[lo:hi]
    if unit == "char":
        return np.flatnonzero((part & 0xC0) != 0x80) + lo
    before = (data[lo - 1 : hi - 1] if lo else np.concatenate([[10], data[:hi]]).astype(np.uint8))[: len(part)]
    if unit == "line":
        return np.flatnonzero(before == 10) + lo
    blank, was = [(x == 32) | ((x >= 9) & (x <= 13)) for x in (part, before)]
    return np.flatnonzero(~blank & was) + lo


class Checkpoints:
    """Number of units of a text, and the byte offset of any of them.

    Unit 0 is taken to start with the text, whatever blanks lead it.
    """

    def __init__(self, data: np.ndarray, unit: str = "char", step: int = STEP, strip: int = STRIP):
        self.data, self.unit, self.strip = data, unit, strip
        self.n = 0
        at, units = [], []
        for lo in range(0, len(data), strip):
            found = _starts(data, lo, min(lo + strip, len(data)), unit)
            first = -self.n % step
            at.append(found[first::step])
            units.append(np.arange(self.n + first, self.n + len(found), step))
            self.n += len(found)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.units = np.concatenate(units) if units else np.zeros(0, np.int64)

    def byte(self, unit: int) -> int:
        """Where ``unit`` starts, or the text's end if there is none such."""
        if unit <= 0:
            return 0
        if unit >= self.n:
            return len(self.data)
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        left, lo = unit - int(self.units[k]), int(self.at[k])
        while True:
            found = _starts(self.data, lo, min(lo + self.strip, len(self.data)), self.unit)
            if left < len(found):
                return int(found[left])
            left -= len(found)
            lo += self.strip


def _draws(key: str) -> list[int]:
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: int = 90, spm: int = 20, unit: str = "char", step: int = STEP) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the text with its middle moved to the end.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of those put the
    suffix first; draws are the hash of ``key`` alone.
    """
    if unit not in UNITS or step < 1:
        raise ValueError(f"unit is one of {UNITS}, step at least 1")
    kinds = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}
    p, s, m = (x.encode() for x in MARKS)

    def one(raw: bytes, name: str) -> tuple:
        data = np.frombuffer(raw, np.uint8)
        index = Checkpoints(data, unit, step)
        h1, h2, h3, h4 = _draws(name)
        if not raw or p in raw or s in raw or m in raw or h3 % 100 >= rate:
            return index.n, "plain", None, None, raw
        a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        x, y = index.byte(a), index.byte(b)
        prefix, middle, suffix = raw[:x], raw[x:y], raw[y:]
        form = "spm" if h4 % 100 < spm else "psm"
        whole = b"".join([s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle])
        sizes = (a, b - a) if unit == "char" else [int(((data[i:j] & 0xC0) != 0x80).sum()) for i, j in ((0, x), (x, y))]
        return index.n, form, *sizes, whole

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text).cast(pa.large_binary())
            keys = batch.column("_key")
            rows = [one(t.as_py() or b"", k.as_py() or "") for t, k in zip(texts, keys)]
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            out = {c: pa.array(v, t) for c, v, t in zip(kinds, columns, types)}
            return out | {"output": pa.array(columns[4], pa.large_binary()).cast(pa.large_string()).cast(pa.string())}

        return each

    return mapped(docs.withColumn("_key", F.col(key).cast("string")), make, kinds).drop("_key")


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` from: plain column expressions."""
    first = F.when(form == "spm", F.lit(MARKS[1])).otherwise(F.lit(MARKS[0]))
    second = F.when(form == "spm", F.lit(MARKS[0])).otherwise(F.lit(MARKS[1]))
    size = len(MARKS[0])
    body = F.substr(output, F.length(first) + 1)
    at = F.position(second, body)
    head, rest = F.substr(body, F.lit(1), at - 1), F.substr(body, at + size)
    cut = F.position(F.lit(MARKS[2]), rest)
    tail, middle = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut + size)
    return F.when(form == "plain", output).when(form == "spm", F.concat(tail, middle, head)).otherwise(F.concat(head, middle, tail))
