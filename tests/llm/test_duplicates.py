"""Duplicates, language model and pipeline against brute force on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stratagraph.llm import lm, neardup, substrings, vectors
from stratagraph.llm.components import components

WORDS = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 120))) for _ in range(n // 3)]
    out = list(base)
    for i in range(n // 3):
        w = base[i].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [base[0]] * 5 + [" ".join(rng.choices(WORDS, k=9)) + " " + " ".join(base[1].split()[:25]) for _ in range(8)]
    return out + [None, "", "  ", "one", "ONE", "one", "a b", "Ünï \t code"]


def frame(spark, texts):
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "one", "c", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, kept int")


def lowered(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()]


def union_find(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = corpus()
    sets = []
    for t in texts:
        w = lowered(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(len(texts), links)
    rows = neardup.near_duplicates(frame(spark, texts), k=k).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
            continue
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_last_round(spark, monkeypatch):
    """Without star rounds everything is left to the last one, in several blocks."""
    monkeypatch.setattr(neardup, "STARS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 4_000)
    texts = corpus(seed=3)
    a = neardup.near_duplicates(frame(spark, texts), k=2).collect()
    monkeypatch.undo()
    b = neardup.near_duplicates(frame(spark, texts), k=2).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize("owners", [(0, 1, 0), (1, 0, 1), (1, 1, 0), (0, 0, 1)])
def test_last_round_across_blocks(owners):
    """The only link of a unit of two blocks involves its largest id, whichever block holds it."""
    rng = np.random.default_rng(1)
    same, other = (np.sort(rng.integers(0, 1 << 63, 100, np.uint64)) for _ in range(2))
    first = next(i for i in range(2) if owners[i] != owners[2])
    n, m = 3, 8
    table = pa.table(
        {
            "unit_no": [0] * n,
            "key": [5] * n,
            "t": [0] * n,
            "id": [10, 20, 30],
            "label": [10, 20, 30],
            "own": list(owners),
            "bi": [0] * n,
            "bj": [1] * n,
            "keys": [list(range(2 * m))] * n,
            "bits": [[0] * (neardup.BITS // 64)] * n,
            "hashes": pa.array([(same if i in (first, 2) else other).tobytes() for i in range(n)], pa.binary()),
        }
    )
    found = neardup._crossed(table, 80, m).to_pylist()
    assert [{r["a"], r["b"]} for r in found] == [{10 * (first + 1), 30}]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert lm.score(none).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("chunk, group", [(8 << 20, 1_500_000), (2_000, 300)])
def test_repeated_passages(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "GROUP", group)
    texts = corpus(seed=2)
    seen, want = set(), []
    for t in texts:
        w = (t or "").split()
        gone = [0] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [1] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substrings.remove_repeats(frame(spark, texts), with_text=True).filter("doc_id is not null").collect()
    assert sum(w[1] for w in want) > 100
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


@pytest.mark.parametrize("head, shard", [(lm.HEAD, lm.SHARD), (50, 300)])
def test_language_model_counts(spark, monkeypatch, head, shard):
    """Base columns equal brute force, with one shard and all words listed, and with many shards and few words."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SHARD", shard)
    texts = corpus(seed=5)
    toks = [lowered(t) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = collections.Counter(w for i, ws in enumerate(toks) if not held[i] for w in ws)
    total = sum(counts.values())
    rows = [r for r in lm.score(frame(spark, texts)).collect() if r["doc_id"] is not None]
    assert len(rows) == len(texts)
    for r in rows:
        ws = toks[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws))
        assert r["score"] < 0
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_sums_to_one(monkeypatch):
    """After any context, seen or not, the outcomes' probabilities add up to one."""
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 60, 40)
    v = lm.Vocabulary(np.arange(40, dtype=np.uint64) * np.uint64(977), counts, int(counts.sum()) + 30, 60, 1, 2000)
    contexts = [(1, 2), (1, 3), (4, 2), (lm._BEGIN, lm._BEGIN)]
    before, skipped, outcome = (np.array(x) for x in zip(*[(b, s, o) for b, s in contexts for o in range(41)]))
    n = rng.integers(0, 3, len(outcome)) * rng.integers(0, 2, len(outcome))
    n[before == 4] = 0
    model = lm.Shard(before, skipped, outcome, n, v)
    p = np.exp(model.log[model.event]).reshape(4, 41).sum(axis=1)
    assert p == pytest.approx(1, abs=1e-4)


def test_language_model_beats_its_base(spark):
    """On held-out documents of given text the model's log-probability a token is above the base's by a tenth at least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs).filter("held_out").selectExpr("sum(score) / sum(n_tokens) as model", "sum(base_score) / sum(n_tokens) as base").collect()[0]
    assert r["model"] > 0.9 * r["base"]


def test_language_model_generalises(spark):
    """Held-out texts of which no near copy was learned: a tenth above the base in sum, and above it for 95 of 100 texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = lm.score(docs).toPandas().set_index("doc_id")
    groups = neardup.near_duplicates(docs, k=2).toPandas().set_index("doc_id")["component_id"]
    learned = set(groups[~scored["held_out"].reindex(groups.index)])
    new = scored[scored["held_out"] & ~groups.reindex(scored.index).isin(learned)]
    assert len(new) > 80
    assert new["score"].sum() > 0.9 * new["base_score"].sum()
    assert (new["score"] > new["base_score"]).mean() >= 0.95


def test_language_model_unknown_words():
    """The words of the last class and the unknown one share it wholly, whatever their counts."""
    times = np.array([1, 1, 1, 2, 2, 5])
    for discount in (0.1, 0.5, 0.95):
        v = lm.Vocabulary(np.arange(4, dtype=np.uint64), np.array([9, 8, 8, 6]), 31 + int(times.sum()), 10, 1, 100, discount)
        assert (10 ** v.rare(np.append(times, 0))).sum() == pytest.approx(1)


@pytest.mark.parametrize("block", [vectors.BLOCK, 3])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(80):
        v = centres[i % 6] + rng.standard_normal(16) * (0.03 if i % 4 else 1.0)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(80, rows[1][1], 1), (81, rows[1][1], 1), (82, None, 1), (83, [0.0] * 16, 1), (84, [float("nan")] * 16, 1), (85, [None] * 16, 1), (86, rows[1][1], None), (87, [], 1), (88, [2 * x for x in rows[1][1]], 1)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    unit = {}
    for i, v, y in rows:
        if v and y is not None and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(v), y
    links = [(i, j) for i in unit for j in unit if j < i and unit[i][1] == unit[j][1] and unit[i][0] @ unit[j][0] >= 0.98]
    want = union_find(89, links)
    for i in range(89):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in p for p in links), want[i], want[i] == i), i


def test_pipeline_stages(spark, tmp_path):
    """Each stage on a small table: what goes, what stays, and the columns."""
    rng = random.Random(9)
    clean = [" ".join(rng.choices(WORDS, k=60)) for _ in range(12)]
    leak = " ".join(f"leak{i}" for i in range(20))
    texts = clean + [clean[0], clean[1] + " extra", f"{clean[2][:90]} {leak} tail", 'token = "abcdef0123456789abcdef" ' + " ".join(rng.choices(WORDS, k=30)), "you stupid idiot, worthless trash, you moron", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(16, 1, 1), (0, 1, 0), (3, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == corpus_pipeline.COLUMNS
        left.append({r["doc_id"] for r in d.collect()})
    everything = set(range(len(texts)))
    assert left[1] == left[0] - {12, 13}
    assert left[2] == left[1] - {14}
    assert left[3] == left[2] and {17, 18, 15} <= left[3] <= everything
    assert "abcdef0123456789" not in d.filter("doc_id = 15").collect()[0]["text"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == left[3] and "ids_sha256" in out.columns


def test_repeated_ids_of_vectors(spark):
    """One id with two vectors, each near another row's: its links are added, all three ids are one component."""
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (2, [1.0, 0.001], 0, "x"), (3, [0.001, 1.0], 0, "x"), (4, [-1.0, 0.0], 0, "x")]
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, kept string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(given).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_components_by_groups(spark, monkeypatch):
    """One group answers at once, without a round; several are joined by rounds; ids may be text."""
    from stratagraph.operators import components as module

    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    want = union_find(300, links)
    want = {i: want[i] for pair in links for i in pair if pair[0] != pair[1]}
    table = spark.createDataFrame(links, "a bigint, b bigint")
    marks = []
    mark = module._mark
    monkeypatch.setattr(module, "_mark", lambda edges: marks.append(1) or mark(edges))
    assert {r["id"]: r["component"] for r in components(table).collect()} == want and not marks
    monkeypatch.setattr(module, "LINKS", 20)
    assert {r["id"]: r["component"] for r in components(table).collect()} == want and marks
    monkeypatch.setattr(module, "LINKS", 1 << 18)
    text = components(spark.createDataFrame([("b", "é"), ("c", "b"), ("x", "z")], "a string, b string"))
    assert {r["id"]: r["component"] for r in text.collect()} == {"b": "b", "é": "b", "c": "b", "x": "x", "z": "x"}
