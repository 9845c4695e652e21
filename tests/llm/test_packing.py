"""Packing: ids against the tokenizers library, every id in one piece, gapless sequences, little padding, plans against brute force."""

import random
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratagraph.llm import merges, packing, queries
from stratagraph.llm.tokens import default_vocabulary

LIBRARY = Tokenizer.from_file(default_vocabulary())
ODD = ["a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "İstanbul ΣΑΣ ß É é", "x\x1cy\x85z w v", "'s don't 'RE aaaaaaa aaaa", "日本語 1²½ 🙂🙂", "a" * 3000, None, "", " \n\t "]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    rng = random.Random(3)
    letters = "aaaabbc'stre<|>endofx .,İΣσß́é  \x1c\x85日本1²½\n🙂"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    machine = merges.Encoder(open(default_vocabulary(), encoding="utf-8").read())
    for _ in range(2):  # the second time from the table of known words
        flat, size = machine(pa.array(texts))
        for t, got in zip(texts, np.split(flat, np.cumsum(size)[:-1])):
            assert got.tolist() == ids(t)
    assert machine(pa.array(["", None]))[1].tolist() == [0, 0]


def test_words_of_equal_hash(monkeypatch):
    """Words are told apart by their letters even if all hashes are equal."""
    monkeypatch.setattr(merges._Strings, "hashes", lambda self: np.zeros(len(self.bounds) - 1, np.uint64))
    machine = merges.Encoder(open(default_vocabulary(), encoding="utf-8").read())
    for text in ("one two three", "two four", "three one one five"):
        assert machine(pa.array([text]))[0].tolist() == ids(text)


def test_combinations_and_least_squares():
    for total, depth in ((1, 1), (7, 3), (12, 4)):
        want = {tuple(sorted(c, reverse=True)) for c in combinations_with_replacement(range(total + 1), depth) if sum(c) == total}
        got = packing.combinations(total, depth)
        assert {tuple(r) for r in got.tolist()} == want and len(got) == len(want)
    combos = packing.combinations(6, 3)
    x = np.zeros(len(combos))
    x[[1, 3]] = 40, 25
    histogram = np.zeros(7)
    for c, n in zip(combos, x):
        for b in c[c > 0]:
            histogram[b] += n
    fitted = packing.least_squares(combos, histogram)
    made = sum(np.bincount(c, minlength=7) * n for c, n in zip(combos, fitted))
    assert (fitted >= 0).all() and np.allclose(made[1:], histogram[1:])


@pytest.mark.parametrize("case", ["even", "one length", "long", "ones", "few", "empty"])
def test_plans(case):
    rng = np.random.default_rng(2)
    sizes = {
        "even": rng.integers(1, 2048, 3000),
        "one length": np.r_[np.full(1000, 1100), rng.integers(1, 900, 500)],
        "long": np.full(301, 1500),
        "ones": np.ones(5000, int),
        "few": np.array([2000, 5]),
        "empty": np.zeros(0, int),
    }[case]
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.Plan({**histogram, 2048: 3})
    length = np.r_[sizes, [2048] * 3].astype(np.int64)
    number = np.zeros(len(length), np.int64)
    for s in set(length.tolist()):
        number[length == s] = np.arange((length == s).sum())
    row, at = packing.places(plan.arrays(), length, number, 2048)
    a = plan.arrays()
    seen = defaultdict(list)
    spots = defaultdict(list)
    for r, k in zip(row, at):
        assert a["first"][k] <= number[r] < a["first"][k] + a["count"][k]
        seen[r].append((a["start"][k], a["size"][k]))
        spots[a["sequence"][k] + number[r] - a["first"][k]].append((a["offset"][k], a["size"][k]))
    for r, parts in seen.items():
        ends = np.cumsum([s for _, s in sorted(parts)])
        assert [p for p, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == length[r]
    check_sequences(spots.values(), length.sum())
    assert len(seen) == len(length) and len(spots) == plan.sequences


def check_sequences(sequences, total, share=0.02):
    room = 0
    for parts in sequences:
        ends = np.cumsum([s for _, s in sorted(parts)])
        assert [p for p, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
        room += 2048
    assert room - total <= share * total + 2048


def check(rows, texts):
    """Every id of every document in one piece, by the library's own ids."""
    spots, pieces, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        spots[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts:
        want = np.array([*ids(text), 1], "<u4")
        total += len(want)
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    assert set(pieces) == {i for i, _ in texts}
    check_sequences(spots.values(), total)


def test_given_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.op12_packing(spark, d).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_awkward_rows(spark):
    texts = list(enumerate(ODD * 3 + ["many words of one text " * 4000] + ["the same length " * 200] * 60))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id bigint, text string, ids string, task int").repartition(5)
    rows = packing.pack(docs).collect()
    check(rows, texts)
    assert any(r["start"] % 2048 for r in rows), "some rests are cut"
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one two"), (None, "three"), ("b", "one two")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["length"]) for r in packing.pack(named, with_ids=False).collect())
    assert got == [("", 2), ("b", 3), ("b", 3)]
