"""Operator 4: toxicity by a weighted lexicon.

Texts are folded (lower case, accents and homoglyphs to plain letters, digit
and symbol substitutions to the letters they stand for), then an Aho-Corasick
automaton finds all lexicon entries (whole words, or the beginnings of words)
and exception phrases in one pass.  The
summed weight, less the phrases', is normalised by a power of the text's
length and turned into a probability by a logistic curve.

Weights, exceptions, the power and the curve are learned from a bounded
sample of labelled training documents; a short built-in list of insults stands
in where labels are few.  Null and empty texts score as texts without hits.
Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Logistic, labelled_sample, mapped, remainder

#: Labelled documents that weights are learned from, at most.
SAMPLE = 20_000
#: Learned words and exception phrases, at most.
LEXICON = 1_000
PHRASES = 500
#: Significance (log-odds over its standard error) that a learned word needs.
MIN_Z = 2.5
#: Share of the toxic documents that it must be in.
MIN_SHARE = 0.02
#: Log ratio of rates that it needs, and the letters of it that count.
MIN_LOG_RATIO = 1.0
MIN_STEM, MAX_STEM = 3, 10
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)

# Common English insults, and letters that look like plain ones.
INSULTS = (
    "idiot idiots moron morons stupid dumb dumbass imbecile loser losers scum trash garbage worthless pathetic "
    "disgusting clown clowns fool jerk creep pig vermin filth filthy bastard bitch asshole dickhead prick slut whore "
    "retard retarded crap shit bullshit fuck fucking fucker wanker twat cunt degenerate lowlife parasite cretin "
    "nitwit halfwit braindead hideous repulsive despicable kill yourself"
).split()
HOMOGLYPHS = {
    **dict(zip("аеорсухкмтнвіјѕԁһԛԝɡ", "aeopcyxkmthbijsdhqwg")),
    **dict(zip("αβεηικμνορτυχωγ", "abenikmvoptuxwy")),
    **dict(zip("ıłøđħŧßæœþð", "ilodhtsaopd")),
}
DIGITS = dict(zip("013457896", "oieastbgg"))
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}

_INSIDE = re.compile(r"(?<=[^\W_])[@$!|€£]+(?=[^\W_])")


class _Fold(dict):
    """Code point to plain letter or space, worked out when first met."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        out = HOMOGLYPHS.get(c) or DIGITS.get(c)
        if out is None:
            base = unicodedata.normalize("NFKD", c).lower()
            base = "".join([HOMOGLYPHS.get(x) or DIGITS.get(x) or x for x in base if not unicodedata.combining(x)])
            out = base if base.isalpha() else "" if unicodedata.combining(c) or c in "​‌‍﻿­" else " "
        self[cp] = out
        return out


_fold = _Fold()


def folded(text: str) -> str:
    """The text's words in plain letters, each with one or more spaces on both sides."""
    text = text.lower()
    if not {"@", "$", "!", "|", "€", "£"}.isdisjoint(text):
        text = _INSIDE.sub(lambda m: "".join([SYMBOLS[c] for c in m[0]]), text)
    return f" {text.translate(_fold)} "


@dataclass
class Model:
    """A fitted lexicon; small enough to send to every executor (bounded by LEXICON + PHRASES)."""

    weights: dict[str, float]
    phrases: dict[str, float]
    power: float
    curve: Logistic

    def matcher(self):
        """A function from a folded text to its summed weight and number of hits."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        entries = {f" {t}": (w, 1) for t, w in self.weights.items()} | {f" {t} ": (w, -1) for t, w in self.phrases.items()}
        for key, value in entries.items():
            machine.add_word(key, value)
        if not entries:
            return lambda text: (0.0, 0)
        machine.make_automaton()

        def match(text: str) -> tuple[float, int]:
            total, hits = 0.0, 0
            for _, (w, n) in machine.iter(text):
                total += w
                hits += n
            return total, hits

        return match


def _stem(word: str, listed) -> str | None:
    """The listed word beginning that ``word`` starts with; none is a beginning of another."""
    return next((word[:k] for k in range(MIN_STEM, MAX_STEM + 1) if word[:k] in listed), None)


def _counted(sample: DataFrame, units) -> DataFrame:
    """Of each unit, by label: documents, occurrences and their sum of squares over documents."""
    names = [f"{c}{y}" for y in (0, 1) for c in ("docs", "sum", "sq")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                for term, n in Counter(units(folded(t).split())).items():
                    row = seen.setdefault(term, [0] * 6)
                    k = 3 * min(1, max(0, y))
                    row[k] += 1
                    row[k + 1] += n
                    row[k + 2] += n * n
        columns = {"term": pa.array(list(seen), pa.string())}
        yield pa.RecordBatch.from_pydict(columns | {c: pa.array([r[i] for r in seen.values()], pa.int64()) for i, c in enumerate(names)})

    rows = sample.select("text", "label").mapInArrow(run, "term string, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])


def _lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of word beginnings (log ratio of their rates in either label) and of exception phrases, both bounded."""
    insults = {f"{t} ": 3.0 for t in INSULTS}
    size = {r["label"]: r for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if 0 not in size or 1 not in size:
        return insults, {}
    bad, good = size[1], size[0]
    stems = _counted(sample, lambda ws: [w[:k] for w in ws for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1)])
    rate = F.log((F.col("sum1") + 0.5) / (bad["chars"] + 1.0)) - F.log((F.col("sum0") + 0.5) / (good["chars"] + 1.0))
    spread = F.sqrt((F.col("sq1") + 0.5) / F.pow(F.col("sum1") + 0.5, 2) + (F.col("sq0") + 0.5) / F.pow(F.col("sum0") + 0.5, 2))
    best = stems.filter(F.col("docs1") >= max(3, MIN_SHARE * bad["n"])).select("term", rate.alias("w"), (rate / spread).alias("z"), F.round(rate * F.pow("docs1", F.lit(0.75)), 3).alias("gain")).filter((F.col("z") >= MIN_Z) & (F.col("w") >= MIN_LOG_RATIO))
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for r in best.orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(8 * LEXICON).collect():
        t = r["term"]
        if len(chosen) < LEXICON and t not in beginnings and _stem(t, chosen) is None:
            chosen[t] = min(6.0, r["w"])
            beginnings.update(t[:k] for k in range(MIN_STEM, len(t)))
    weights = chosen | {t: w for t, w in insults.items() if _stem(t.strip(), chosen) is None}

    def around(ws: list[str]) -> list[str]:
        marked = [_stem(w, chosen) is not None or f"{w} " in weights for w in ws]
        return [f"{ws[i]} {ws[i + 1]}" for i in range(len(ws) - 1) if marked[i] != marked[i + 1]]

    clean = _counted(sample, around).filter(F.col("docs0") >= max(3, 0.1 * MIN_SHARE * good["n"])).filter(F.col("docs1") * 20.0 * good["n"] <= F.col("docs0") * float(bad["n"]))
    phrases = {}
    for r in clean.orderBy(F.desc("docs0"), "term").limit(PHRASES).collect():
        for w in r["term"].split(" "):
            hit = _stem(w, chosen) or (f"{w} " if f"{w} " in weights else None)
            if hit:
                phrases[r["term"]] = -weights[hit]
    return weights, phrases


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, bound: int = SAMPLE) -> Model:
    """Fit a model on labelled documents whose crc32 remainder is not ``held``."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", modulus, held, bound)
    weights, phrases = _lexicon(sample)
    draft = Model(weights, phrases, 0.0, Logistic(np.zeros((0, 1)), np.zeros(0)))
    rows = features(sample, draft).select("label", "weight", "n_words").collect()  # three numbers a row, at most ``bound`` rows
    y = np.array([r["label"] for r in rows], float)
    fits = []
    for power in POWERS:
        x = np.array([_signal(r["weight"], r["n_words"], power) for r in rows], float).reshape(-1, 1)
        fits.append((Logistic(x, y, ridge=1e-1), power))
    curve, power = min(fits, key=lambda f: f[0].loss)
    return Model(weights, phrases, power, curve)


def _signal(weight: float, n_words: int, power: float) -> float:
    return math.log1p(max(0.0, weight) * (100.0 / (n_words + 20.0)) ** power)


def features(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``weight`` (summed), ``n_hits`` and ``n_words`` of the folded text."""

    def make():
        match = model.matcher()

        def each(batch: pa.RecordBatch) -> dict:
            out = []
            for t in batch.column(text):
                f = folded(t.as_py() or "")
                out.append((*match(f), len(f.split())))
            w, h, n = zip(*out) if out else ((), (), ())
            return {"weight": pa.array(w, pa.float64()), "n_hits": pa.array(h, pa.int64()), "n_words": pa.array(n, pa.int64())}

        return each

    return mapped(docs, make, {"weight": "double", "n_hits": "bigint", "n_words": "bigint"})


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``n_hits``, ``score`` (0 to 1, higher: likelier toxic) and ``predicted``; one pass, no shuffle."""

    def make():
        match = model.matcher()

        def each(batch: pa.RecordBatch) -> dict:
            x, hits = [], []
            for t in batch.column(text):
                f = folded(t.as_py() or "")
                w, h = match(f)
                x.append(_signal(w, len(f.split()), model.power) if w > 0 else 0.0)
                hits.append(h)
            p = model.curve(np.array(x, float))
            return {"n_hits": pa.array(hits, pa.int64()), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

        return each

    return mapped(docs, make, {"n_hits": "bigint", "score": "double", "predicted": "int"})


def held_out(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """Add ``held_out``: whether the document's fold is the one that learning leaves out; false for a null id."""
    return docs.withColumn("held_out", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)))
