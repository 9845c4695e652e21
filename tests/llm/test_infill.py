"""Fill-in-middle: every row against a plain slicing twin, the checkpoint index against a full table, exact restoring."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import infill, queries

TEXTS = [None, "", "a", "é", "plain text", "has <P> in it", "<S", "ends with <", "x<M>y", "línea uno\nzwei  über\n\n\t drei 🙂🙂 " * 400, "🙂" * 70_000, "a b\n" * 50_000, "plain text"]


def twin(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def test_rows_and_restoring(spark):
    rows = [(i, t, "kept", 7) for i, t in enumerate(TEXTS * 9)] + [(None, "no id at all", "kept", 7), (-3, "below zero", "kept", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, other int")
    got = infill.transform(docs).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == twin(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["other"] == 7
    assert infill.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", infill.UNITS)
def test_checkpoints(unit):
    rng = random.Random(5)
    for size in (0, 1, 3, 50, 4000):
        text = "".join(rng.choices("aé🙂 \n\tbc", k=size))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = infill._starts(data, 0, len(data), unit)
        for step, strip in ((1, 7), (3, 64), (1024, 100)):
            index = infill.Checkpoints(data, unit, step, strip)
            assert index.n == len(starts) and len(index.at) == -(-index.n // step)
            for k in range(0, index.n + 1, max(1, index.n // 40)):
                assert index.byte(k) == (0 if k == 0 else len(data) if k >= index.n else starts[k])


def test_units(spark):
    docs = spark.createDataFrame([(i, f"one  two\nthree {i}\n" * 9) for i in range(40)], "doc_id bigint, text string")
    for unit, n in (("word", 36), ("line", 18)):
        got = infill.transform(docs, unit=unit, step=4).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
        assert all(r["n"] == n and r["back"] == r["text"] for r in got)
        for r in got:
            if r["form"] != "plain":
                rest = r["text"][r["prefix_chars"] :]
                assert not rest or not r["prefix_chars"] or r["text"][r["prefix_chars"] - 1].isspace()
    with pytest.raises(ValueError):
        infill.transform(docs, unit="page")


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_fill_in_middle(spark, str(tmp_path)).collect()}
    for i, t in rows:
        sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
        n, form, a, b, out = twin(i, t)
        assert tuple(got[i][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) == (n, form, a, b, sha(out), sha(t))
