"""Scans, scores and encodings on awkward texts: nulls, empty and very long ones, repeats, clashing columns."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

from stratagraph.llm import decontam, personal, quality, secrets, tokens, toxicity
from stratagraph.llm.common import labelled_sample

TEXTS = [None, "", " ", "plain words only", "plain words only", "x" * 200_000, "word " * 40_000, "é ß Σ ΑΣ \x1c 𝄞"]


def docs(spark, texts, **extra):
    rows = [(i, t, "mine", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n int")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, extra int")


def secret_twin(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_base_spans(spark):
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef0", "abc", " ", "secret", "\n", "é"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = secrets.scan(docs(spark, texts)).collect()
    assert len(rows) == len(texts) and {"n", "spans", "n_hex"} <= set(rows[0].asDict())
    for r in rows:
        want = secret_twin(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
    assert secrets.scan(empty(spark)).count() == 0


def test_guess_cost_orders_values():
    weak = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "summer2019", "letmein"]
    strong = ["x7Kq9vTz2LmP", "9f8a7c6b5d4e3f2a", "Zp4!mQ8#rW"]
    assert max(map(secrets.guess_cost, weak)) < secrets.MIN_COST <= min(map(secrets.guess_cost, strong))
    assert secrets.guess_cost("") == 0


def test_secret_values_and_mask(spark):
    text = "login: hunter and pwd=x7Kq9vTz2LmPw! end, password = tr0ub4dor&3x9Qz"
    spans = secrets.find(text)
    assert [k for k, _, _ in spans].count("value") >= 1
    got = secrets.scan(docs(spark, [text, None, "clean"]), redact=True).orderBy("doc_id").collect()
    assert "x7Kq9vTz2LmPw" not in got[0]["text"] and got[1]["text"] is None and got[2]["text"] == "clean"


def test_secret_values_of_any_length():
    """The span reaches the end of the value, and the cost is found in linear time."""
    rng = random.Random(6)
    key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789+/") for _ in range(900))
    for text in (f"auth={key} end", f'private_key: "{key}"', f"pwd: '{key}'"):
        assert secrets.masked(text, secrets.find(text)) == text.replace(key, "[SECRET]")
    # a base span stops at the first other character of the value
    text = "password=abcDEF123456!tail9Zq more"
    assert secrets.masked(text, secrets.find(text)) == "[SECRET] more"
    for unit in ("a", "qw", "abc", "password"):
        assert secrets.guess_cost(unit * 20_000, secrets.MIN_COST) <= secrets.MIN_COST


def test_secret_values_without_digits():
    """The cost decides: random letters and symbols are secrets, words are not."""
    for value in ("kGvQ!xTzRw#m", "qVxzKwplRtyb", "ZkXq-vWpT!mJ"):
        assert secrets.find(f'pwd: "{value}"') == [("value", 6, 6 + len(value))]
    for prose in ("password: required", "auth: international", "login: username", "passphrase = information", "credentials: not-required"):
        assert secrets.find(prose) == []


def personal_twin(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_base_spans(spark):
    rng = random.Random(8)
    alphabet = "aB9._%+-@ .()0123456789\n𝄞é,"
    texts = TEXTS[:5] + ["a.b@c.d_e@f.g.h.1.2.3.4.5.6", "1" * 20_000, "a." * 20_000, "0.0.0.0 256.1.1.1", "4111 1111 1111 1111"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    rows = personal.scan(docs(spark, texts)).collect()
    for r in rows:
        want = personal_twin(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest(), texts[r["doc_id"]]
        assert r["spans"].startswith(",".join("%s:%d:%d" % s for s in want))
    assert personal.scan(empty(spark)).count() == 0


def test_personal_texts_of_many_matches(spark):
    """Thousands of matches in one text, at and beside the ends of the blocks in which they are gathered."""
    counts = [1, 2, 3, 4, 8, 9, 15, 16, 17, 5_000]
    texts = [" ".join(f"u{i}@h{i % 7}.org +1 555 010 {1000 + i} é" for i in range(n)) for n in counts]
    for r in personal.scan(docs(spark, texts)).collect():
        want = personal_twin(texts[r["doc_id"]])
        assert r["n_email"] == counts[r["doc_id"]] and r["n_phone"] == counts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()


def test_personal_candidates(spark):
    found = {r["doc_id"]: r["spans"] for r in personal.scan(docs(spark, ["my ssn is 123-45-6789 ok", "mail john (at) corp (dot) com now", "order 123456789", "in all 12345678901 words"])).collect()}
    assert found[0] == "number:10:21" and found[1].startswith("spelled:5:")
    assert found[2] == "" and found[3] == ""


def test_personal_plan_is_native(spark):
    plan = personal.scan(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_tokens_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokens.default_vocabulary()
    ours, theirs = tokens.Automaton(json.load(open(path))), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [t for t in TEXTS if t is not None] + ["<|startoftext|>hi<|endoftext|> x", "it's don'T", "aaaa" * 40]
    texts += ["".join(rng.choice("abcdeiorstnlzé' 0!$\n") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for t in texts:
        ids, labels = ours.encode(t)
        want = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert labels == theirs.decode(want, skip_special_tokens=False) == ours.decode(ids)
    rows = tokens.encode(docs(spark, TEXTS)).collect()
    assert [r["n_tokens"] for r in rows[:2]] == [0, 0] and len(rows[3]["ids"]) == rows[3]["n_tokens"]
    assert tokens.encode(empty(spark)).count() == 0


def labelled(spark, name, good, bad, n=120):
    rows = [(i, (bad if i % 3 == 0 else good)(i)) for i in range(n)]
    labels = [(i, int(i % 3 == 0) if name == "toxic" else int(i % 3 != 0)) for i in range(n)] + [(None, 1), (5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, f"doc_id bigint, {name} int")


def test_toxicity(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    pick = lambda i, k: " ".join(random.Random(i).choices(words, k=k))
    d, y = labelled(spark, "toxic", lambda i: pick(i, 60), lambda i: pick(i, 30) + " blorgface " + pick(i + 999, 30) + " blorgface")
    model = toxicity.learn(d, y)
    assert "blorgface" in model.weights
    test = docs(spark, TEXTS + ["you Bl0rgf@ce " + pick(1, 20), "you idi0t, you іdiot", pick(3, 50)])
    got = {r["doc_id"]: r for r in toxicity.score(test, model).collect()}
    assert [got[i]["predicted"] for i in range(len(TEXTS))] == [0] * len(TEXTS)
    assert got[8]["predicted"] == 1 and got[9]["n_hits"] == 2 and got[10]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # no labels at all: the built-in list alone
    bare = toxicity.learn(d, y.limit(0))
    assert toxicity.score(empty(spark), bare).count() == 0


def test_quality(spark):
    good = lambda i: " ".join(random.Random(i).choices(["river", "stone", "under", "light", "meadow", "and", "the"], k=80))
    bad = lambda i: " ".join(w + "$$$" for w in random.Random(i).choices(["zx", "qq", "###", "buy"], k=80))
    d, y = labelled(spark, "quality", good, bad)
    model = quality.learn(d, y)
    got = {r["doc_id"]: r for r in quality.score(docs(spark, TEXTS + [good(500), bad(501)]), model).collect()}
    assert got[8]["score"] > 0.7 and got[8]["predicted"] == 1 and got[9]["score"] < 0.5
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"]
    assert quality.score(empty(spark), quality.learn(d, y.limit(0))).count() == 0


def test_quality_learns_from_all_parts(spark, monkeypatch):
    """What tells the labels apart stands behind the first piece of each text."""
    monkeypatch.setattr(quality, "PIECE", 100)
    same = "a common beginning of every text " * 10
    good = lambda i: same + " ".join(random.Random(i).choices(["river", "stone", "under", "light", "meadow"], k=80))
    bad = lambda i: same + " ".join(random.Random(i).choices(["zx$", "qq$", "###", "buy$", "0x0"], k=80))
    model = quality.learn(*labelled(spark, "quality", good, bad))
    assert b"meadow" in model.good and b"meadow" not in model.bad


def test_equal_texts_of_differing_labels(spark):
    """The row of the smallest doc_id stands for equal texts."""
    rows = spark.createDataFrame([(i, "the same") for i in range(40)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    for parts in (1, 7):
        got = labelled_sample(rows.repartition(parts), marks.repartition(parts), "toxic", 5, 0, 100).collect()
        ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
        assert [(r["doc_id"], r["label"]) for r in got] == [(ids[0], ids[0] % 2)]


def test_decontamination_with_text_ids(spark):
    item = " ".join(f"item{i}" for i in range(20))
    d = spark.createDataFrame([("one", f"before {item} after", 5), ("two", "nothing of it", 6), (None, item, 7)], "doc_id string, text string, item_id int")
    b = spark.createDataFrame([("first", item), ("second", None)], "item_id string, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.find_passages(d, b).collect()]
    assert sorted(got, key=str) == [("one", "first"), (None, "first")] or sorted(got, key=str) == [(None, "first"), ("one", "first")]
    assert {r["doc_id"] for r in decontam.clean(d, b).collect()} == {"two", None}


def test_decontamination(spark):
    item = " ".join(f"item{i}" for i in range(20))
    near = item.replace("item19", "other")
    far = item.replace("item10", "other")
    pad = " ".join(f"pad{i}" for i in range(50))
    texts = [None, "", pad, f"{pad} {item} {pad}", f"{pad} {near.upper()} {pad}", f"{far} {pad}", item, f"{item} {item}", "one two", "x one two three x"]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three")], "item_id bigint, text string")
    got = decontam.find_passages(docs(spark, texts), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3, 1), (4, 1), (6, 1), (7, 1), (9, 4)}
    assert sum(r["doc_id"] == 7 for r in got) == 2
    kept = decontam.clean(docs(spark, texts), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 5, 8] and kept.columns == ["doc_id", "text", "spans", "n"]
    assert decontam.find_passages(docs(spark, texts), items.limit(0)).count() == 0
    assert decontam.find_passages(empty(spark), items).count() == 0
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_decontamination_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BYTES", 200)
    items = [(i, " ".join(f"a{i}b{j}" for j in range(12))) for i in range(9)]
    d = docs(spark, ["x y z " + t for _, t in items])
    got = decontam.find_passages(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(9)}


def test_decontamination_of_short_documents(spark):
    """Items with words dropped at an end are found though no window of the item's size fits."""
    words = [f"item{i}" for i in range(38)]
    texts = [" ".join(words[:-1]), " ".join(words[2:]), " ".join(words[:20]), " ".join(words[1:-1]).upper()]
    got = decontam.find_passages(docs(spark, texts), spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], round(r["similarity"], 6)) for r in got} == {(0, 0, 37, round(33 / 34, 6)), (1, 0, 36, round(32 / 34, 6)), (3, 0, 36, round(32 / 34, 6))}


def test_decontamination_weights_in_blocks(spark, monkeypatch):
    """Similarities don't depend on how the items are cut into blocks."""
    shared = " ".join(f"s{j}" for j in range(12))
    items = [(i, f"{shared if i % 2 else ''} " + " ".join(f"a{i}b{j}" for j in range(14))) for i in range(9)] + [(9, None), (10, "two words")]
    texts = [f"x {t} y" for _, t in items[:9]] + [f"{t.rsplit(' ', 1)[0]} other {shared}" for _, t in items[:9]]
    find = lambda: sorted((r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 9)) for r in decontam.find_passages(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    want = find()
    assert any(s < 1 for *_, s in want)
    monkeypatch.setattr(decontam, "ITEM_BYTES", 300)
    assert find() == want
