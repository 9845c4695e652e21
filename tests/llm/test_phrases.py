"""Collocations: suffix arrays and intervals against plain counting, whole results against a counting twin."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import phrases


def twin(rows, least=30, longest=4, covered=80, top=2000):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, *w[i : i + n]] += 1
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        score, k, l, r = min(((2000000 * a) // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    held = Counter()
    for (lang, *w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                held[lang, *w[i : i + n]] = max(held[lang, *w[i : i + n]], a)
    out = sorted(x for x in out if 100 * held[x[0], *x[3].decode().split(" ")] < covered * -x[2])
    rank, got = Counter(), set()
    for lang, s, a, p, l, r in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.add((lang, rank[lang], p.decode(), -a, l, r, totals[lang], -s))
    return got


def same(spark, rows, **how):
    docs = spark.createDataFrame([(t, l, 0, "x") for t, l in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = [tuple(r) for r in phrases.mine(docs, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == twin(rows, **how)
    return got


def texts(seed, n):
    rng = random.Random(seed)
    words = ["A", "b", "é", "\x1c", "new", "York", "city", "hall", " ", "x-y"]
    weights = [9, 7, 2, 1, 5, 5, 4, 3, 1, 1]
    ends = [" ", "  ", "\t", " . ", ",", "\n", "!? ", "\x0b"]
    for _ in range(n):
        yield "".join(rng.choices(words, weights)[0] + rng.choices(ends, [30, 3, 2, 2, 2, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])


def test_against_counting(spark, monkeypatch):
    rows = [*texts(1, 300), (None, "en"), ("", None), ("   \n\t .,", "de"), ("New York City Hall " * 6000, "en"), *[("the same passage of some words again", "fr")] * 40]
    assert len(same(spark, rows)) > 20
    monkeypatch.setattr(phrases, "SHARD", 200)  # many shards, each with few of the counts
    same(spark, rows, least=9, covered=60, top=7)
    same(spark, rows, least=5, longest=2)
    same(spark, rows, least=20, longest=6)


def test_small_and_empty(spark):
    assert same(spark, [("one", "en")], least=1) == []
    assert len(same(spark, [("one two", None), ("three", "en"), (None, None)], least=1)) == 1
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert phrases.mine(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.mine(docs, longest=1)


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for depth in (1, 2, 3, 4, 7):
        ids = rng.integers(0, 4, 300)
        head = rng.random(300) < 0.1
        head[0] = True
        heads = np.append(np.flatnonzero(head), 300)
        left = np.repeat(heads[1:], np.diff(heads)) - np.arange(300)
        order = phrases.suffix_array(ids, left, depth)
        tail = lambda i: tuple(ids[i : i + min(depth, left[i])])
        assert sorted(order) == list(range(300)) and all(tail(a) <= tail(b) for a, b in zip(order, order[1:]))
        lcp = phrases.common(ids, left, order, depth)
        for n in range(1, depth + 1):
            place, count, inside = phrases.intervals(order, lcp, left, n)
            want = Counter(tuple(ids[i : i + n]) for i in range(300) if left[i] >= n)
            assert dict(zip([tuple(ids[p : p + n]) for p in place], count)) == want and len(place) == len(want)
            for k, i in zip(inside, order):
                assert (k < 0) == (left[i] < n) and (k < 0 or tuple(ids[place[k] : place[k] + n]) == tuple(ids[i : i + n]))


def test_a_full_filter_costs_no_count(spark, monkeypatch):
    """Every bit set: more rows travel, the result is the same."""
    rows = list(texts(2, 200))
    monkeypatch.setattr(phrases.Filter, "of", classmethod(lambda cls, frequent: cls(np.full(8192, 255, np.uint8))))
    same(spark, rows, least=12)


def test_filter_holds_all(spark):
    rows = [(f"l{i % 3}", f"word {i}") for i in range(5000)]
    got = phrases.Filter.of(spark.createDataFrame(rows, "lang string, phrase string"))
    strings = lambda x: phrases._Strings.of(pa.array([s.encode() for s in x], pa.large_binary()))
    every = np.arange(len(rows))
    assert got(strings([r[0] for r in rows]), every, strings([r[1] for r in rows])).all()
    assert got(strings([r[0] for r in rows]), every, strings([r[1] + "!" for r in rows])).mean() < 0.1
