"""Scalar functions at their edges, SQL names, landing writers."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import codes, scalars as S, sql
from marketlens.operators import landing, metrics, replay
from marketlens.plans import lens


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


@pytest.mark.parametrize("text, scale, want", [
    ("43000.10", 2, 4300010), (" 1.239 ", 2, 123), ("7", 8, 700000000), (".5", 1, 5), ("", 2, 0), ("-1.5", 1, -15), ("-0.00010000", 9, -100000), ("1e5", 2, None), ("abc", 2, None), ("1.2.3", 2, None), ("12", 0, 12), ("0.123456789123", 9, 123456789),
])
def test_parse_scaled(spark, text, scale, want):
    t = F.col("t")
    got = values(spark, [(text, scale)], "t string, s int", fixed=S.parse_scaled(t, scale), column=S.parse_scaled(t, F.col("s")), strict=S.parse_scaled(t, scale, False))[0]
    assert got[:2] == (want, want)
    assert got[2] == (None if text.strip() in ("", ".5") else want)


def test_hashes(spark):
    # published shard examples need only the definition: FNV-1a over venue, market and symbol
    def fnv(data):
        h = 2166136261
        for b in data:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    symbols = ["BTCUSDT", "ETHUSDT", "", "ÄÖÜ€"]
    got = values(spark, [(s,) for s in symbols], "s string", i=S.instrument_id(F.col("s")), shard=S.shard_of(F.col("s"), 16, 1, 2))
    assert got == [(fnv(s.encode()), fnv(bytes([1, 2]) + s.encode()) % 16) for s in symbols] and got[0][0] == 3895251564
    sql.register(spark)
    rows = spark.sql("SELECT fnv1a32(s), shard_for(1, 2, s, 16), to_d8(12345, 10), to_d8(-7, 2), bps_apart(100, 99), client_order_id(1, 255) FROM VALUES ('BTCUSDT'), ('') AS t(s)").collect()
    assert sorted((r[0], r[1]) for r in rows) == sorted((fnv(s.encode()), fnv(bytes([1, 2]) + s.encode()) % 16) for s in ("BTCUSDT", "")) and tuple(rows[0][2:]) == (123, -7_000_000, 100, "cc-0001-00000000000000ff")


def test_rescale_is_exact_for_large_values(spark):
    big = 9_007_199_254_740_993 * 100 + 99
    assert values(spark, [(big,)], "m long", down=S.rescale(F.col("m"), 10), neg=S.rescale(-F.col("m"), 10)) == [(big // 100, -(big // 100))]


def test_order_ids(spark):
    got = values(spark, [("cc-000a-00000000000000ff",), ("web_1",), ("cc-zz-1",)], "c string", i=S.order_instance(F.col("c")), n=S.order_counter(F.col("c")))
    assert got == [(10, 255), (None, None), (None, None)]


def test_codes(spark):
    assert values(spark, [(2,), (9,), (None,)], "c int", n=codes.name_of(F.col("c"), codes.AGGRESSORS)) == [("Sell",), (None,), (None,)]


def test_buckets_are_inclusive(spark):
    got = values(spark, [(0,), (1_000,), (1_001,), (5_000_000_001,)], "v long", b=metrics.bucket(F.col("v")))
    assert [b for (b,) in got] == [1_000, 1_000, 5_000, metrics.OVERFLOW]


def test_percentile_of_buckets(spark):
    df = spark.createDataFrame([("a", 500)] * 99 + [("a", 1_000_000)], "k string, v long")
    p = {r["p"]: r["bound"] for r in metrics.bucket_percentiles(metrics.histogram(df, "v", ["k"]), ["k"], [50, 99, 100]).collect()}
    assert p == {50.0: 1_000, 99.0: 1_000, 100.0: 1_000_000}


def test_landing_writers(spark, sf, tmp_path):
    ticks = lens.view(spark, sf, "ticks").select("symbol", F.col("ts_ns").alias("exchange_event_ts"), F.when(F.col("event_type") == "view", 5).otherwise(6).alias("message_type"), (F.col("k") % 10).alias("shard_id"))
    paths = landing.write_by_type(ticks, str(tmp_path / "tables"))
    assert spark.read.parquet(paths["trades"]).count() == ticks.where("message_type = 6").count()
    landing.write_shards(ticks, str(tmp_path / "shards"), 8)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == ticks.where("shard_id < 8").count() and back.where("shard_id = 3").count() == ticks.where("shard_id = 3").count()


def test_replay(spark):
    frames = spark.createDataFrame([("r", i, 100 + 10 * i, bytes([i, 255])) for i in range(50)], "recording string, frame_id long, captured_at_ns long, payload binary")
    due = {r["frame_id"]: r["emit_at_ns"] for r in replay.emit_times(frames, 1_000, 1, 0).collect()}
    assert due[0] == 1_000 and due[3] == 1_030
    sent = replay.inject(frames, 0, 100, 0, 3)
    for r in sent.select("frame_id", "payload", "flipped_at").collect():
        want = bytearray([r["frame_id"], 255])
        want[r["flipped_at"]] ^= 0xFF
        assert bytes(r["payload"]) == bytes(want)
    s = replay.statistics(replay.inject(frames, 50, 0, 50, 3), frames).first()
    assert s["delivered"] + s["dropped"] == 50 and s["dropped"] > 10 and s["duplicated"] > 5
    assert replay.inject(frames, 50, 20, 50, 3).count() == replay.inject(frames.repartition(5), 50, 20, 50, 3).count()
