"""Timers, maps and two feeds in keyed state against their batch versions."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import book, folds
from marketlens.plans import lens
from marketlens.plans.queries import QUERIES
from marketlens.plans.time_queries import ORDER_TIMEOUT
from marketlens.streaming import keyed

from test_streaming import drain, split


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    keyed.state_store(spark)
    yield
    spark.conf.set(name, before)


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def last_state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_silence_makes_orders_unknown(spark, sf, tmp_path):
    events = lens.view(spark, sf, "lifecycles").select("order_id", "ts_ns", F.when(F.col("event") == "submit", 0).otherwise(1).alias("ord"), "event")
    events = events.withColumns({"trade_id": F.lit(0).cast("long"), "qty": F.lit(0).cast("long"), "total_qty": F.lit(100).cast("long")})
    split(events, tmp_path / "in", ["ts_ns", "ord", "order_id"], parts=4)
    # one row long after the others moves event time past the last waiting time; it is no order's
    end = spark.createDataFrame([(-1, 2_000_000_000_000_000_000, 9, "tick", 0, 0, 100)], events.schema)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed.orders(stream, ORDER_TIMEOUT, 30 * 86_400 * folds.SECOND, "0 seconds")
    query = out.writeStream.format("memory").queryName("orders").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("orders")
    silent = got.where("event = 'silence'").select("order_id", F.col("ts_ns").alias("unknown_at"))
    newest = events.agg(F.max("ts_ns")).first()[0]
    want = QUERIES["g18_silent_orders"](spark, sf)
    assert want.count() > 100
    assert rows(silent.where(F.col("unknown_at") < newest), ("order_id", "unknown_at")) == rows(want, ("order_id", "unknown_at"))
    assert got.where("event = 'silence' and (status <> 'UnknownStatus' or action <> 'ScheduleCheck')").count() == 0
    # finished orders left the state: only those that were acknowledged and go on are in it
    going_on = events.groupBy("order_id").agg(F.bool_or(F.col("event").isin("reject", "cancel")).alias("done"), F.bool_or(F.col("event") == "ack").alias("acked")).where("order_id >= 0 and acked and not done").count()
    assert last_state_rows(query) <= going_on + 1 < events.select("order_id").distinct().count()


def test_timers_by_hand(spark, tmp_path):
    s = folds.SECOND
    schema = "order_id long, ts_ns long, ord long, event string, trade_id long, qty long, total_qty long"
    batches = [
        [(1, 0, 0, "submit", None, 0, 100), (2, 0, 0, "submit", None, 0, 100), (2, 1 * s, 1, "ack", None, 0, 100), (3, 0, 0, "submit", None, 0, 100)],
        [(9, 6 * s, 0, "submit", None, 0, 100)],  # event time passes 5 seconds: 1 and 3 are unknown
        [(1, 7 * s, 0, "fill", 1, 30, 100), (1, 8 * s, 0, "ack", None, 0, 100), (9, 8 * s, 1, "ack", None, 0, 100)],
        [(9, 200 * s, 2, "fill", 2, 100, 100)],
        [(9, 201 * s, 3, "ack", None, 0, 100)],  # event time has passed the end of 3's keeping
        [(3, 202 * s, 0, "ack", None, 0, 100)],
    ]
    for batch in batches:
        batch = [(order, at + 1_000 * s, *rest) for order, at, *rest in batch]  # time 0 is the first watermark
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(keyed.orders(stream, 5 * s, 100 * s, "0 seconds"), "byhand", tmp_path / "ck").collect()
    by = {i: [(r["event"], r["status"], r["action"], r["filled_qty"]) for r in got if r["order_id"] == i] for i in (1, 2, 3, 9)}
    assert by[1] == [("submit", "Pending", "Submitted", 0), ("silence", "UnknownStatus", "ScheduleCheck", 0), ("fill", "UnknownStatus", "Buffered", 0), ("ack", "PartiallyFilled", "ApplyAck", 30)]
    assert by[2] == [("submit", "Pending", "Submitted", 0), ("ack", "New", "ApplyAck", 0)]
    assert by[3] == [("submit", "Pending", "Submitted", 0), ("silence", "UnknownStatus", "ScheduleCheck", 0), ("forget", "UnknownStatus", "Forgotten", 0), ("ack", "None", "Ignored", 0)]
    assert [x[1] for x in by[9]] == ["Pending", "New", "Filled", "None"]


def test_book_tops_by_levels(spark, sf, tmp_path):
    updates = lens.view(spark, sf, "book")
    split(updates, tmp_path / "in", ["n", "symbol"])
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    columns = ("symbol", "n", "best_bid", "best_ask")
    assert rows(drain(keyed.book_tops(stream), "levels", tmp_path / "ck"), columns) == rows(book.tops(updates), columns)


def test_an_update_writes_one_level(spark, tmp_path):
    schema = "symbol string, n long, kind string, side string, price long, qty long"
    spark.createDataFrame([("A", i, "snapshot" if i == 0 else "delta", "B", i, 1) for i in range(300)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("A", 300, "delta", "B", 7, 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keyed.book_tops(stream).writeStream.format("memory").queryName("one").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert updated[0] >= 300 and updated[1] <= 3


@pytest.mark.parametrize("window", [64, 3])
def test_verdicts_of_two_feeds(spark, sf, tmp_path, window):
    checks = lens.view(spark, sf, "feed_checksums")
    sides = []
    for side, name in ((checks.where("instance_id = 0"), "active"), (checks.where("instance_id <> 0"), "passive")):
        # files of both feeds cover the same stretches of the order, one of each a trigger
        ordered = side.withColumn("part", F.floor(F.col("ord") / 70))
        for part in sorted(r[0] for r in ordered.select("part").distinct().collect()):
            ordered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = drain(keyed.verdicts(*sides, window), f"verdicts{window}", tmp_path / "ck")
    want = folds.run(checks, folds.checksum_arbiter(window), "symbol", ["ord"])
    columns = ("symbol", "ord", "update_id", "verdict")
    assert rows(got, columns) == rows(want, columns)
    assert {r[0] for r in want.select("verdict").distinct().collect()} == {"Matched", "Diverged", "Pending", "Stale"}
