"""Streaming twins against their batch versions."""

from pyspark.sql import functions as F

from marketlens.operators import folds, refdata
from marketlens.plans import lens
from marketlens.streaming import stateful


def split(df, folder, order, parts=3):
    """The rows as ``parts`` sets of files, in order."""
    rows = df.orderBy(*order).toPandas()
    step = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows.iloc[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(str(folder))


def drain(out, name, checkpoint, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)


def test_sequence_fold(spark, sf, tmp_path):
    deltas = lens.view(spark, sf, "deltas")
    split(deltas, tmp_path / "in", ["n", "symbol"])
    stream = spark.readStream.schema(deltas.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(stateful.run(stream, folds.SPOT_SEQUENCE, "symbol", ["n"]), "sequence", tmp_path / "ck")
    want = folds.run(deltas, folds.SPOT_SEQUENCE, "symbol", ["n"])
    columns = ["symbol", "n", "result", "expected", "actual"]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))


def test_timer_fold(spark, sf, tmp_path):
    attempts = lens.view(spark, sf, "attempts")
    split(attempts, tmp_path / "in", ["ts_ns", "event_id"])
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = folds.circuit_breaker(3, 3_600 * folds.SECOND)
    columns = ["symbol", "event_id", "state_before", "opened", "failures"]
    got = drain(stateful.run(stream, fold, "symbol", ["ts_ns", "event_id"]), "breaker", tmp_path / "ck").select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, folds.run(attempts, fold, "symbol", ["ts_ns", "event_id"]).select(*columns).collect()))


def test_book_tops_fold(spark, sf, tmp_path):
    updates = lens.view(spark, sf, "book")
    split(updates, tmp_path / "in", ["n", "symbol"])
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    columns = ["symbol", "n", "best_bid", "best_ask"]
    got = drain(stateful.run(stream, folds.BOOK_TOP, "symbol", ["n"]), "tops", tmp_path / "ck").select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, folds.run(updates, folds.BOOK_TOP, "symbol", ["n"]).select(*columns).collect()))


def test_definition_changes(spark, sf, tmp_path):
    definitions = lens.view(spark, sf, "definitions").withColumn("body", F.to_json(F.struct(*[c for c in refdata.FIELDS if c not in ("step_size", "min_qty", "contract_size")])))
    split(definitions, tmp_path / "in", ["version", "symbol"])
    stream = spark.readStream.schema(definitions.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    columns = ["symbol", "version", "change", "status_event"]
    got = drain(stateful.run(stream, folds.DEFINITION_CHANGE, "symbol", ["version"]), "changes", tmp_path / "ck").where("change is not null").select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, refdata.changes(definitions, "version").select(*columns).collect()))


def test_rates_and_dedup(spark, sf, tmp_path):
    ticks = lens.view(spark, sf, "ticks").withColumn("ts", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")))
    split(ticks, tmp_path / "in", ["ts_ns"])
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(stateful.rates(stream, "ts", ["event_type"], "1 day", "1 hour"), "rates", tmp_path / "ck1", "complete")
    want = ticks.groupBy(F.window("ts", "1 day"), "event_type").count()
    assert got.agg(F.sum("n")).first()[0] == 1000 and got.count() == want.count()
    once = drain(stateful.first_sightings(stream, ["user_id"], "ts", "100 days"), "once", tmp_path / "ck2")
    assert once.count() == ticks.select("user_id").distinct().count()


def test_landing(spark, sf, tmp_path):
    code = F.when(F.col("event_type") == "view", 5).when(F.col("event_type") == "error", 9).otherwise(13)
    ticks = lens.view(spark, sf, "ticks").withColumn("message_type", code)
    split(ticks, tmp_path / "in", ["ts_ns"])
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.land_by_type(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "best_bid_offers")).count() == ticks.where("message_type = 5").count()
    assert spark.read.parquet(str(tmp_path / "out" / "liquidations")).count() == ticks.where("message_type = 9").count()
