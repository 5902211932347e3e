"""Rows of a task: bounded however many rows the tables have."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import folds
from marketlens.plans import lens
from marketlens.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["g18_unknown_status", "g19_gateway", "f13_current_orders", "g17_order_machine"])
def test_tasks_follow_the_rows(spark, sf, name, monkeypatch):
    want = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(lens, "TASK_ROWS", 500)
    df = QUERIES[name](spark, sf)
    assert sorted(map(repr, df.collect())) == want
    rows = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert df.rdd.getNumPartitions() == -(-2 * rows // 500)
    spread = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert spread < 1_000


def test_windows_beside_a_fold_take_its_sort(spark):
    df = spark.createDataFrame([(k, n, n % 3 > 0) for k in (None, "a", "b") for n in range(9)], "symbol string, ts_ns long, ok boolean")
    beside = {"rn": lambda by: F.row_number().over(by), "last": lambda by: F.lead(F.lit(True)).over(by).isNull()}
    out = folds.run(df, folds.circuit_breaker(2, 4), "symbol", ["ts_ns"], [], 5, beside)
    assert out.rdd.getNumPartitions() == 5
    assert sorted((r["symbol"] or "", r["ts_ns"]) for r in out.where("rn = ts_ns + 1 AND last = (ts_ns = 8)").collect()) == sorted((k, n) for k in ("", "a", "b") for n in range(9))
    plain = folds.run(df, folds.circuit_breaker(2, 4), "symbol", ["ts_ns"])
    columns = ("symbol", "ts_ns", "state_before", "opened", "failures")
    assert sorted(map(repr, out.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))
