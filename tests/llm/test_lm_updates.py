"""Gradient updates of the language model at its own softmax."""

import inspect

import numpy as np
import pytest

from marketlens.llm import lm, queries


def made():
    rng = np.random.default_rng(4)
    n = 40
    model = lm.Model([b"%d" % i for i in range(n)], np.arange(n, 0, -1) * 20, 17_000, 60, np.arange(n) % 3)
    ids = (rng.zipf(1.4, 3_000) - 1) % (n + 1)
    ids[1::2] = (ids[::2] * 7 + 1) % n  # every other word follows from the one before
    first = np.arange(0, 3_000, 50)
    zeros = lambda kind: [np.zeros(t.shape, kind) for t in model.tables]
    observed = zeros(np.float32)
    lm.observe(model, ids, first, observed)
    lm.update(model, observed)
    return model, ids, first, observed, zeros


def test_expected_sums_are_those_of_plain_loops():
    model, ids, first, observed, zeros = made()
    got, want = zeros(np.float64), zeros(np.float64)
    lm.expect(model, ids, first, got)
    for _, level, node, features, _ in lm._parts(model, ids, first):
        for i in range(len(node)):
            z = model.bias[level][node[i]].astype(float) + sum(s * model.tables[level][r[i]] for s, r in zip(lm.SHARES, features, strict=False))
            p = np.exp(z) / np.exp(z).sum()
            for rows in features:
                want[level][rows[i]] += p
    for g, w, o in zip(got, want, observed, strict=True):
        assert np.allclose(g, w, rtol=1e-4, atol=1e-6)
        assert np.allclose(g.sum(1), o.sum(1), rtol=1e-4)  # each row expects as many outputs as it saw


def test_updates_at_the_softmax_raise_the_likelihood():
    model, ids, first, observed, zeros = made()
    told = [lm.log10_model(model, ids, first).sum()]
    for _ in range(3):
        expected = zeros(np.float64)
        lm.expect(model, ids, first, expected)
        lm.follow(model, observed, expected)
        told.append(lm.log10_model(model, ids, first).sum())
    assert told == sorted(told) and told[1] > told[0] + 1


def test_the_query_evaluates_the_softmax_in_training(spark, sf, monkeypatch):
    passes = []
    monkeypatch.setattr(lm, "learn", lambda train, model, n=0, learn=lm.learn: (passes.append(n), learn(train, model, n)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    monkeypatch.setattr(queries, "_read", lambda *_: docs)
    assert queries.op2_lm_scoring(spark, sf).count() == 80
    assert passes == [1] and inspect.signature(lm.score).parameters["passes"].default == 0
    one, many = ({r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n), passes=1).collect()} for n in (1, 9))
    assert one == {i: pytest.approx(x, rel=1e-4) for i, x in many.items()}


def test_each_distinct_history_is_evaluated_once(monkeypatch):
    model, ids, first, observed, zeros = made()
    want, got, rows = zeros(np.float64), zeros(np.float64), []
    lm.expect(model, ids, first, want)
    alone = lm.log10_model(model, ids, first)
    copies = np.tile(ids, 20), np.concatenate([first + len(ids) * i for i in range(20)])
    monkeypatch.setattr(lm, "_logits", lambda m, level, node, f, logits=lm._logits: (rows.append(len(node) * (level == 0)), logits(m, level, node, f))[1])
    lm.expect(model, *copies, got)
    assert sum(rows) == len(set(zip(*lm._history(ids, first), strict=True)))
    assert all(np.allclose(g, 20 * w, rtol=1e-4, atol=1e-6) for g, w in zip(got, want, strict=True))
    assert np.allclose(lm.log10_model(model, *copies), np.tile(alone, 20), rtol=1e-6)


def test_where_tokens_are_cut_for_sorting_changes_nothing(monkeypatch):
    model, ids, first, observed, zeros = made()
    want, got = zeros(np.float64), zeros(np.float64)
    lm.expect(model, ids, first, want)
    told = lm.log10_model(model, ids, first)
    for name, value in (("_SORTED", 701), ("_TOGETHER", 53), ("_CHUNK", 7)):
        monkeypatch.setattr(lm, name, value, raising=False)
    lm.expect(model, ids, first, got)
    assert all(np.allclose(g, w, rtol=1e-4, atol=1e-6) for g, w in zip(got, want, strict=True))
    assert np.allclose(lm.log10_model(model, ids, first), told, rtol=1e-6)


def test_tables_are_shuffled_by_few_tasks_however_many_partitions(spark, monkeypatch):
    model, ids, first, _, _ = made()
    ends = np.append(first[1:], len(ids))
    texts = [(ids[a:b].astype(np.int32).tobytes(),) for a, b in zip(first, ends, strict=True)]
    train = spark.createDataFrame(texts, "ids binary").repartition(60)
    tasks = []
    monkeypatch.setattr(lm, "sum_vectors", lambda data, *a, sums=lm.sum_vectors: (tasks.append(data.rdd.getNumPartitions()), sums(data, *a))[1])
    near = lm.neighbours(train, model)
    monkeypatch.setattr(lm, "TASK_TOKENS", model.total // 9, raising=False)
    again = lm.neighbours(train, model)
    assert tasks == [4, 12]  # of 4 that run at once
    want = np.zeros(near.size, np.float32)
    lm.beside(model, ids, first, want)
    assert (near.reshape(-1) == want).all() and (again == near).all()
