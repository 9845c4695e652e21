"""Operator 5: quality by compression.

Two zstandard dictionaries are built from texts labelled good and bad.  A
text is compressed with either and with none; the differences of the sizes,
normalised, go through a logistic curve that is calibrated on labelled texts
which the dictionaries haven't seen.

Learning takes a bounded sample of labelled training documents.  Null texts
count as empty; every text, empty ones too, gets a score; repeated rows score
alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Logistic, labelled_sample, mapped

#: Labelled documents that are learned from, at most; half build dictionaries, half calibrate.
SAMPLE = 16_000
#: Pieces of each label that a dictionary is built from, at most, and characters of a piece; pieces come from all parts of the texts.
PER_LABEL = 2_000
PIECE = 4_000
DICTIONARY_BYTES = 1 << 16
LEVEL = 3


@dataclass
class Model:
    """Two dictionaries (bounded by DICTIONARY_BYTES each) and the curve."""

    good: bytes
    bad: bytes
    curve: Logistic | None

    def sizes(self):
        """A function from a text's bytes to its features."""

        def by(dictionary: bytes) -> zstandard.ZstdCompressor:
            if not dictionary:
                return zstandard.ZstdCompressor(level=LEVEL)
            d = zstandard.ZstdCompressionDict(dictionary)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

        good, bad, none = by(self.good), by(self.bad), by(b"")

        def each(data: bytes) -> tuple[float, float, float, float]:
            n = len(data) + 1
            g, b, p = len(good.compress(data)), len(bad.compress(data)), len(none.compress(data))
            return (b - g) / (b + g), (g - p) / n, (b - p) / n, p / n

        return each


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where they are too few to train one."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICTIONARY_BYTES]


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, bound: int = SAMPLE) -> Model:
    """Fit a model on labelled documents whose crc32 remainder is not ``held``."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", modulus, held, bound)
    half = F.abs(F.xxhash64("doc_id", F.lit(7))) % 2
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int"))
    pick = sample.filter(half == 0).select("doc_id", "label", "text", F.explode(starts).alias("i"))
    pick = pick.select("label", F.substr("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("text"), F.xxhash64("doc_id", "i").alias("k")).filter("text <> ''")
    parts = {}
    for label in (0, 1):
        rows = pick.filter(F.col("label") == label).orderBy("k", "text").limit(PER_LABEL).select("text").collect()
        parts[label] = _dictionary([r["text"].encode() for r in rows])
    draft = Model(parts[1], parts[0], None)
    rows = _measured(sample.filter(half == 1), draft).select("label", "x").collect()  # five numbers a row, at most ``bound`` rows
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), 4)
    return Model(draft.good, draft.bad, Logistic(x, np.array([r["label"] for r in rows], float)))


def _measured(docs: DataFrame, model: Model) -> DataFrame:
    def make():
        sizes = model.sizes()
        return lambda batch: {"x": pa.array([list(sizes((t.as_py() or "").encode())) for t in batch.column("text")], pa.list_(pa.float64()))}

    return mapped(docs, make, {"x": "array<double>"})


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier good) and ``predicted``; one pass over whole texts, no shuffle."""

    def make():
        sizes = model.sizes()

        def each(batch: pa.RecordBatch) -> dict:
            x = np.array([sizes((t.as_py() or "").encode()) for t in batch.column(text)], float)
            p = model.curve(x)
            return {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

        return each

    return mapped(docs, make, {"score": "double", "predicted": "int"})
