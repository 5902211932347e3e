"""Queries of event time: late rows, silence, versions valid at a time, commits by rows or time, sinks and recorded shards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import scratch_folder
from ..operators import book, commits, folds, lateness, refdata
from ..sources import checksum_sink, recorded
from .catalog import query
from .fold_queries import _walk
from .relational_queries import _CHECKSUMS

_HOUR, _DAY = 3_600 * folds.SECOND, 86_400 * folds.SECOND

#: Rows of a batch, and how far behind the newest row one may be
LATE_BATCH, ALLOWANCE = 100, 2 * _HOUR


@query("j02_late_rows", f"""
    WITH n AS (SELECT *, (row_number() OVER (ORDER BY arrived_ns, event_id) - 1) // {LATE_BATCH} AS batch FROM arrivals),
    b AS (SELECT batch, max(ts_ns) AS top FROM n GROUP BY 1), w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {ALLOWANCE} AS watermark FROM b)
    SELECT n.event_id, n.batch, w.watermark, coalesce(n.ts_ns < w.watermark, false) AS late FROM n JOIN w ON n.batch = w.batch""")
def late_rows(v):
    day = F.floor(F.col("arrived_ns") / _DAY)
    return lateness.judge(v("arrivals"), ["arrived_ns", "event_id"], day, "ts_ns", LATE_BATCH, ALLOWANCE).select("event_id", "batch", "watermark", "late")


@query("j01_watermarks", f"""
    WITH n AS (SELECT *, (row_number() OVER (ORDER BY arrived_ns, event_id) - 1) // {LATE_BATCH} AS batch FROM arrivals),
    b AS (SELECT batch, max(ts_ns) AS top FROM n GROUP BY 1), w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {ALLOWANCE} AS watermark FROM b)
    SELECT w.batch, w.watermark, count(*) AS arrived, count(*) FILTER (n.ts_ns < w.watermark) AS late FROM n JOIN w ON n.batch = w.batch GROUP BY 1, 2""")
def watermarks(v):
    day = F.floor(F.col("arrived_ns") / _DAY)
    rows = lateness.judge(v("arrivals"), ["arrived_ns", "event_id"], day, "ts_ns", LATE_BATCH, ALLOWANCE)
    return rows.groupBy("batch", "watermark").agg(F.count(F.lit(1)).alias("arrived"), F.count_if("late").alias("late"))


#: How long an order waits for an answer before its status is unknown
ORDER_TIMEOUT = 5 * _DAY


@query("g18_silent_orders", f"""
    WITH o AS (SELECT order_id, min(ts_ns) FILTER (event = 'submit') AS opened, min(ts_ns) FILTER (event <> 'submit') AS answered FROM lifecycles GROUP BY 1)
    SELECT order_id, opened + {ORDER_TIMEOUT} AS unknown_at FROM o WHERE coalesce(answered > opened + {ORDER_TIMEOUT}, true) AND opened + {ORDER_TIMEOUT} < (SELECT max(ts_ns) FROM lifecycles)""")
def silent_orders(v):
    asked = F.col("event") == "submit"
    return lateness.silent(v("lifecycles"), "order_id", "ts_ns", asked, ~asked, ORDER_TIMEOUT)


@query("a09_valid_definitions", """
    WITH c AS (SELECT * FROM (SELECT *, lag(struct_pack(a := base_asset, t := tick_size, i := is_trading)) OVER (PARTITION BY symbol ORDER BY version) AS before, row_number() OVER (PARTITION BY symbol ORDER BY version) AS rn FROM refreshes)
               WHERE rn = 1 OR before IS DISTINCT FROM struct_pack(a := base_asset, t := tick_size, i := is_trading)),
    d AS (SELECT *, lead(refreshed_ns) OVER (PARTITION BY symbol ORDER BY refreshed_ns) AS until FROM c)
    SELECT t.trade_id, t.l_orderkey, t.symbol, t.trade_ts, t.price, d.version, d.tick_size, d.is_trading FROM trades t LEFT JOIN d ON t.symbol = d.symbol AND t.trade_ts >= d.refreshed_ns AND (d.until IS NULL OR t.trade_ts < d.until)""")
def valid_definitions(v):
    versions = refdata.changes(v("refreshes"), "version", ("base_asset", "tick_size", "is_trading"))
    trades = v("trades").select("trade_id", "l_orderkey", "symbol", "trade_ts", "price")
    return refdata.valid_at(trades, versions, "trade_ts", "refreshed_ns", ["version", "tick_size", "is_trading"], 30 * _DAY)


#: Limits of a batch of the sink
COMMIT_ROWS, COMMIT_PERIOD = 20, 2 * _HOUR


@query("a17_commits", _walk(
    "SELECT event_type AS symbol, event_id, ts_ns, row_number() OVER (PARTITION BY event_type ORDER BY ts_ns, event_id) AS rn FROM ticks",
    "-1::BIGINT AS started, 0::BIGINT AS held, 0::BIGINT AS commits",
    f"""CASE WHEN f.started < 0 OR f.held >= {COMMIT_ROWS} OR r.ts_ns >= f.started + {COMMIT_PERIOD} THEN r.ts_ns ELSE f.started END,
        CASE WHEN f.started < 0 OR f.held >= {COMMIT_ROWS} OR r.ts_ns >= f.started + {COMMIT_PERIOD} THEN 1 ELSE f.held + 1 END,
        CASE WHEN f.started >= 0 AND (f.held >= {COMMIT_ROWS} OR r.ts_ns >= f.started + {COMMIT_PERIOD}) THEN f.commits + 1 ELSE f.commits END""",
    'r.symbol AS "table", r.event_id, f.commits AS "commit"'))
def commit_numbers(v):
    rows = v("ticks").select(F.col("event_type").alias("table"), "event_id", "ts_ns")
    return commits.numbered(rows, "table", "ts_ns", "event_id", COMMIT_ROWS, COMMIT_PERIOD).select("table", "event_id", "commit")


@query("a23_checksum_sink", _CHECKSUMS)
def checksums_through_the_sink(v):
    versions = v("deltas").groupBy("symbol").agg(F.max("final_id").alias("update_id"))
    checks = book.checksums(book.latest_levels(v("book")), versions)
    spark, folder = checks.sparkSession, scratch_folder(checks.sparkSession, "book-checksums")
    checksum_sink.register(spark)
    checks.select(*checksum_sink.FIELDS).write.format("book_checksums").mode("append").option("path", folder).save()
    return spark.read.format("book_checksums").option("path", folder).load().select(*checksum_sink.FIELDS)


#: Shards that frames are recorded in, and bytes of a range of a file
SHARDS, SPLIT = 4, 1 << 18


@query("a22_recorded_frames", """
    SELECT ts_ns AS captured_at_ns, event_id, symbol, price, 'raw_ws' AS source_kind, cast(row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) as bigint) AS frame FROM ticks""")
def recorded_frames(v):
    frame = F.to_json(F.struct(F.col("ts_ns").alias("captured_at_ns"), F.lit("raw_ws").alias("source_kind"), F.to_json(F.struct("event_id", "symbol", "price")).alias("payload")))
    ticks = v("ticks")
    spark, folder = ticks.sparkSession, scratch_folder(ticks.sparkSession, "recorded")
    ticks.select(frame.alias("value")).repartition(SHARDS).write.text(folder)
    recorded.register(spark)
    frames = spark.read.format("recorded_frames").option("path", folder).option("suffix", ".txt").option("splitBytes", SPLIT).load()
    told = frames.select("captured_at_ns", "source_kind", F.from_json("payload", "event_id long, symbol string, price long").alias("p")).select("captured_at_ns", "source_kind", "p.*")
    order = F.row_number().over(Window.partitionBy("symbol").orderBy("captured_at_ns", "event_id"))
    return told.withColumn("frame", order.cast("long"))
