"""Whole epochs: late rows on the side, commits of several tables at once, failures midway."""

import pytest
from pyspark.sql import functions as F

from marketlens.operators import commits, landing, lateness
from marketlens.plans import lens
from marketlens.plans.queries import QUERIES
from marketlens.plans.time_queries import ALLOWANCE, LATE_BATCH
from marketlens.streaming import epochs


def stream_of(spark, df, folder, order, size):
    """A stream of one file a trigger, of ``size`` rows each, in order."""
    rows = df.orderBy(*order).toPandas()
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows.iloc[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_on_the_side(spark, sf, tmp_path):
    stream = stream_of(spark, lens.view(spark, sf, "arrivals"), tmp_path / "in", ["arrived_ns", "event_id"], LATE_BATCH)
    out = str(tmp_path / "out")
    epochs.split_late(stream, "ts_ns", ALLOWANCE, out, str(tmp_path / "ck")).awaitTermination()
    parts = [epochs.read(spark, out, t).select("event_id", F.col("epoch").cast("long").alias("batch"), "watermark", F.lit(t == "late").alias("late")) for t in ("on_time", "late")]
    want = QUERIES["j02_late_rows"](spark, sf)
    assert sorted(map(repr, parts[0].unionByName(parts[1]).collect())) == sorted(map(repr, want.collect()))
    assert want.where("late").count() > 5 and want.where("not late").count() > 100


def test_watermarks_over_many_batches(spark):
    values = [(i, (i * 7919) % 1000) for i in range(500)]
    got = lateness.running_max(spark.createDataFrame(values, "n long, v long"), "n", "v", "m", block=7).collect()
    assert sorted((r["n"], r["m"]) for r in got) == [(i, max((v for n, v in values if n < i), default=None)) for i in range(500)]


def plain_commits(times, max_rows, period):
    out, started, held, n = [], None, 0, 0
    for t in times:
        if started is not None and (held >= max_rows or t >= started + period):
            n, started = n + 1, None
        if started is None:
            started, held = t, 0
        held += 1
        out.append(n)
    return out


@pytest.mark.parametrize(("max_rows", "period"), [(5, 100), (3, 10), (1, 5), (50, 1000), (7, 37)])
def test_commits_against_a_plain_loop(spark, max_rows, period):
    import random

    rng = random.Random(max_rows)
    rows, want = [], {}
    for table in ("a", "b", None):
        times = sorted(rng.randrange(0, 3000) if rng.random() < 0.7 else rng.randrange(20_000, 20_050) for _ in range(300))
        want |= {(table, i): c for i, c in enumerate(plain_commits(times, max_rows, period))}
        rows += [(table, i, t) for i, t in enumerate(times)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = commits.numbered(spark.createDataFrame(rows, "table string, id long, t long").repartition(5), "table", "t", "id", max_rows, period).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["table"], r["id"]): r["commit"] for r in got} == want


def messages(spark, sf):
    code = F.when(F.col("event_type") == "view", 5).when(F.col("event_type") == "error", 9).when(F.col("event_type") == "click", 6).otherwise(13)
    return lens.view(spark, sf, "ticks").withColumn("message_type", code)


def test_a_batch_that_fails_midway_is_seen_whole_or_not_at_all(spark, sf, tmp_path, monkeypatch):
    ticks = messages(spark, sf)
    stream = stream_of(spark, ticks, tmp_path / "in", ["ts_ns", "event_id"], 400)
    out, checkpoint, real, calls = str(tmp_path / "out"), str(tmp_path / "ck"), epochs.EpochLog.finish, []

    def failing(log, epoch, **entry):
        calls.append(epoch)
        if epoch == 1 and calls.count(1) == 1:
            raise OSError("lost")  # all tables of the epoch are written, its entry is not
        real(log, epoch, **entry)

    monkeypatch.setattr(epochs.EpochLog, "finish", failing)

    def run():
        epochs.land(stream, "ts_ns", "event_id", out, checkpoint, max_rows=20, period=3_600_000_000_000).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    first = ticks.orderBy("ts_ns", "event_id").limit(400)
    for code, table in ((5, "best_bid_offers"), (9, "liquidations"), (6, "trades")):
        assert epochs.read(spark, out, table).count() == first.where(F.col("message_type") == code).count()
    run()
    for code, table in landing.TABLES.items():
        got = epochs.read(spark, out, table)
        assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in ticks.where(F.col("message_type") == code).select("event_id").collect())
    assert calls == [0, 1, 1, 2]
    # commits are those of each epoch's rows by themselves
    want = commits.numbered(first.where("message_type = 9").withColumn("_t", F.lit("x")), "_t", "ts_ns", "event_id", 20, 3_600_000_000_000)
    got = epochs.read(spark, out, "liquidations").where("epoch = 0")
    assert sorted(map(tuple, got.select("event_id", "commit").collect())) == sorted(map(tuple, want.select("event_id", "commit").collect()))


def test_a_finished_epoch_is_not_written_again(spark, tmp_path):
    log = epochs.EpochLog(spark, str(tmp_path))
    one, two = (spark.createDataFrame([(x,)], "x long") for x in (1, 2))
    assert log.newest() == -1 and log.entry(0) is None
    assert epochs.write_epoch(log, 0, {"t": one, "u": one}, note=5) and not epochs.write_epoch(log, 0, {"t": two, "u": two})
    two.write.parquet(f"{tmp_path}/t/epoch=1")  # of an epoch that failed
    assert [r["x"] for r in epochs.read(spark, str(tmp_path), "t").collect()] == [1]
    assert log.entry(0) == {"note": 5} and log.newest() == 0
