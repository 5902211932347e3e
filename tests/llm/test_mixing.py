"""Targets and takes of the source mix, held against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from marketlens.llm import mixing


def plain_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        room = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else room * weight[s] / open_ for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] and s not in capped}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, "d": 7, None: 300},
    {"a": 1, "b": 1, "c": 1},
    {"a": 500, "b": 1},
    {"only": 12},
    {"a": 3, "b": 0, "c": 100},
    {f"s{i}": 20_000 + 13 * i for i in range(20)},
])
def test_targets_reshare_what_capped_sources_leave(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in docs.join(mixing.mix(docs), "doc_id").collect()}
    for s, t in plain_targets(sizes).items():
        assert math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(sum(got.values()), sum(sizes.values()))


def test_takes_come_near_the_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").cache()
    assert mixed.count() == docs.count()
    assert mixed.where((F.col("taken") > 3 * F.col("size")) | (F.col("taken") % F.greatest("size", F.lit(1)) != 0)).count() == 0
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r["t"] - r["target"]) <= r["largest"]
    again = mixing.mix(docs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_take_agrees_with_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["repeats"] for r in mixing.take(docs).select("doc_id", "repeats").collect()}
    for r in mixing.mix(docs).collect():
        assert r["taken"] == r["size"] * taken.get(r["doc_id"], 0)


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (None, "a b", None, "x"), (1, "", "s", "x"), (1, "c d e", "s", "y"), (1, "c d e", "s", "y"), (2, " ", "empty", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bar string")
    out = mixing.mix(docs).collect()
    assert len(out) == 6 and sum(r["size"] for r in out) == 8
    assert mixing.take(docs).columns == ["doc_id", "text", "source", "bar", "repeats"]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [None, 7])
def test_texts_under_one_id_are_taken_each_for_itself(spark, name):
    rows = [(name, " ".join([f"t{i}"] * 5), "a") for i in range(400)] + [(1000 + i, "x y z", "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = [r for r in mixing.mix(docs, weights=(1.0, 2.0)).collect() if r["doc_id"] == name]
    assert len(a) == 400
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 5 and a[0]["target"] < a[0]["source_size"]
