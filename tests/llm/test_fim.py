"""Fill-in-the-middle against plain slicing."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import fim
from .odd import documents


def plain(doc_id, text, seed="1"):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("text", ["a", "é" * 700, "x" * 5000, "a😀é漢b" * 900, "\x00\U0010ffff", "ab" * 100_000])
def test_selected_boundaries(text):
    data = text.encode()
    n, *rest = fim.encode_list(fim.boundaries(data))
    assert n == len(text)
    for k in {0, 1, n // 3, n // 2, max(0, n - 1), n}:
        assert fim.select(k, *rest) == len(text[:k].encode())


def test_lists_of_sparse_numbers():
    values = np.cumsum(np.random.default_rng(0).integers(1, 5000, 3000))
    _, width, *rest = fim.encode_list(values)
    assert width > 8 and [fim.select(k, width, *rest) for k in range(0, 3000, 7)] == values[::7].tolist()


def check(rows, docs):
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["back"]) for r in rows)
    want = [(repr(i), *(x or 0 if j in (2, 3) else x for j, x in enumerate(plain(i, t))), t or "") for i, t in docs]
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [200, 1])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(fim, "HOT_TEXT", hot)  # with 1, every text of two documents is looked up by several tasks
    more = [(100 + i, t) for i, t in enumerate(["holds <P> itself", "<S>", "a<M", "b>", "<P", "日本語" * 40, "same", "same", "same", "\r\n \t"] * 6)]
    docs = documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    check(out.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [200, 1])
def test_different_texts_of_one_digest(spark, monkeypatch, hot):
    monkeypatch.setattr(fim, "HOT_TEXT", hot)
    rows = [(i, f"text number {i % 7} " * (i % 3 + 1)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_in_middle(docs, digest=lambda t: F.length(t).cast("long")).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    check(out.collect(), rows)


def test_texts_are_shuffled_once(spark, sf):
    """Of the exchanges that carry texts, one is of the texts of few documents, and one of those of many, of which there are none here."""
    df = fim.fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("partial_collect_set(text") == plan.count("partial_collect_list(struct(id") == 1


def test_a_third_of_all_rows_with_one_text(spark):
    rows = [(i, "the same text for all of these" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    check(out, rows)
