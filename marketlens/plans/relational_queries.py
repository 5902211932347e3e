"""Queries of joins, sets, aggregates, books and reference data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import book, folds, joins, metrics, refdata, replay
from ..sources import binary, journal
from .catalog import query
from .scalar_queries import with_header


@query("flagship_turnover", """
    WITH t AS (SELECT t.symbol, t.price, t.qty, i.is_trading, i.base_asset FROM trades t JOIN instruments i ON t.symbol = i.symbol)
    SELECT base_asset, is_trading, count(*) AS trades, sum(qty)::BIGINT AS volume, sum(price * qty)::BIGINT AS turnover, sum(price * qty)::DOUBLE / sum(qty)::DOUBLE AS vwap FROM t GROUP BY 1, 2""")
def flagship(v):
    t = joins.with_instruments(v("trades").select("symbol", "price", "qty"), v("instruments").select("symbol", "is_trading", "base_asset"))
    # exact in 38 digits, whatever the number of rows; the products fit into a long
    turnover = F.sum((F.col("price") * F.col("qty")).cast("decimal(19,0)"))
    return t.groupBy("base_asset", "is_trading").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("volume"), turnover.cast("long").alias("turnover"), (turnover.cast("double") / F.sum("qty")).alias("vwap"))


@query("e01_instrument_join", """SELECT t.trade_id, t.price, t.trade_ts, t.qty, i.symbol, i.is_trading FROM trades t JOIN instruments i ON t.symbol = i.symbol WHERE i.is_trading""")
def instrument_join(v):
    return joins.with_instruments(v("trades"), v("instruments").where("is_trading").select("symbol", "is_trading")).select("trade_id", "price", "trade_ts", "qty", "symbol", "is_trading")


@query("e01_unknown_symbols", """SELECT DISTINCT t.symbol FROM trades t LEFT JOIN (SELECT * FROM instruments WHERE is_trading) i ON t.symbol = i.symbol WHERE i.symbol IS NULL""")
def unknown_symbols(v):
    return v("trades").select("symbol").join(v("instruments").where("is_trading").select("symbol"), "symbol", "left_anti").distinct()


@query("e02_default_scales", """SELECT t.trade_id, t.price, coalesce(i.price_scale, 8) AS price_scale, coalesce(i.qty_scale, 8) AS qty_scale, t.qty, t.trade_ts FROM trades t LEFT JOIN (SELECT * FROM instruments WHERE is_trading) i ON t.symbol = i.symbol""")
def default_scales(v):
    return joins.with_scales(v("trades").drop("price_scale", "qty_scale"), v("instruments").where("is_trading")).select("trade_id", "price", "price_scale", "qty_scale", "qty", "trade_ts")


@query("e03_checksum_pairs", """
    WITH s AS (SELECT symbol, update_id, arg_max(checksum, ord) FILTER (instance_id = 0) AS active, arg_max(checksum, ord) FILTER (instance_id <> 0) AS passive FROM checksums GROUP BY 1, 2)
    SELECT *, CASE WHEN active IS NULL OR passive IS NULL THEN 'Pending' WHEN active = passive THEN 'Matched' ELSE 'Diverged' END AS verdict FROM s""")
def checksum_pairs(v):
    return joins.checksum_pairs(v("checksums"))


_SAMPLES = """
    a AS (SELECT symbol, ts_ns // 3600000000000 AS tick, arg_max(bid_price, (ts_ns, update_id)) AS b, arg_max(ask_price, (ts_ns, update_id)) AS k FROM bbo WHERE instance_id = 0 GROUP BY 1, 2),
    s AS (SELECT symbol, ts_ns // 3600000000000 AS tick, arg_max(bid_price, (ts_ns, update_id)) AS b, arg_max(ask_price, (ts_ns, update_id)) AS k FROM bbo WHERE instance_id = 1 GROUP BY 1, 2),
    j AS (SELECT coalesce(a.symbol, s.symbol) AS symbol, coalesce(a.tick, s.tick) AS tick, a.b AS ab, a.k AS ak, s.b AS sb, s.k AS sk FROM a FULL JOIN s ON a.symbol = s.symbol AND a.tick = s.tick),
    h AS (SELECT symbol, tick, last_value(ab IGNORE NULLS) OVER w AS ab, last_value(ak IGNORE NULLS) OVER w AS ak, last_value(sb IGNORE NULLS) OVER w AS sb, last_value(sk IGNORE NULLS) OVER w AS sk FROM j
          WINDOW w AS (PARTITION BY symbol ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    samples AS (SELECT symbol, tick, CASE WHEN ab = 0 THEN 0 ELSE trunc(abs(ab - sb) * 10000 / ab)::BIGINT END AS bid_bps, CASE WHEN ak = 0 THEN 0 ELSE trunc(abs(ak - sk) * 10000 / ak)::BIGINT END AS ask_bps
                FROM h WHERE ab IS NOT NULL AND sb IS NOT NULL),
    stats AS (SELECT symbol, count(*) AS samples, count(*) FILTER (bid_bps > 50 OR ask_bps > 50) AS divergences, max(bid_bps) AS max_bid_bps, max(ask_bps) AS max_ask_bps FROM samples GROUP BY 1)"""
_HOUR = 3_600_000_000_000


def _samples(v):
    b = v("bbo")
    return joins.shadow_samples(b.where("instance_id = 0"), b.where("instance_id = 1"), _HOUR)


@query("e04_shadow_samples", f"WITH {_SAMPLES} SELECT * FROM samples")
def shadow_samples(v):
    return _samples(v)


@query("f09_shadow_stats", f"WITH {_SAMPLES} SELECT * FROM stats")
def shadow_stats(v):
    return joins.shadow_stats(_samples(v), 50)


@query("f10_shadow_verdict", f"""
    WITH {_SAMPLES}, w AS (SELECT symbol, greatest(max_bid_bps, max_ask_bps) AS worst FROM stats WHERE 100.0 * divergences / samples > 20 AND greatest(max_bid_bps, max_ask_bps) > 0 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT (SELECT sum(samples) FROM stats)::BIGINT AS samples, CASE WHEN (SELECT count(*) FROM w) > 0 THEN 'Diverging' ELSE 'Stable' END AS verdict, (SELECT symbol FROM w) AS worst_symbol, (SELECT worst FROM w) AS worst_bps,
           CASE WHEN (SELECT count(*) FROM w) > 0 THEN 1 ELSE 0 END AS exit_code""")
def shadow_verdict(v):
    return joins.shadow_verdict(joins.shadow_stats(_samples(v), 50), 10, 20.0)


@query("e05_reconcile_orders", """
    WITH x AS (SELECT order_id FROM requests WHERE status = 'O' AND order_id % 5 <> 0), t AS (SELECT order_id FROM requests WHERE order_id % 3 <> 0 AND status <> 'F')
    SELECT coalesce(x.order_id, t.order_id)::VARCHAR AS cloid, CASE WHEN x.order_id IS NOT NULL AND t.order_id IS NOT NULL THEN 'StillLive' WHEN t.order_id IS NULL THEN 'Unexpected' ELSE 'Vanished' END AS action FROM x FULL JOIN t ON x.order_id = t.order_id""")
def reconcile_orders(v):
    r = v("requests").withColumn("cloid", F.col("order_id").cast("string"))
    return joins.reconcile_orders(r.where("status = 'O' AND order_id % 5 <> 0"), r.where("order_id % 3 <> 0 AND status <> 'F'"))


@query("e06_quote_as_of", """
    SELECT m.event_id, m.symbol, m.mark, b.bid_price AS right_bid_price, b.ask_price AS right_ask_price, m.k, m.ts_ns
    FROM marks m ASOF LEFT JOIN (SELECT * FROM bbo WHERE instance_id = 0) b ON m.symbol = b.symbol AND m.ts_ns >= b.ts_ns""")
def quote_as_of(v):
    return joins.as_of(v("marks"), v("bbo").where("instance_id = 0"), "symbol", "ts_ns", ["bid_price", "ask_price"], "update_id").select("event_id", "symbol", "mark", "right_bid_price", "right_ask_price", "k", "ts_ns")


_FINAL = """
    since AS (SELECT symbol, max(n) AS since FROM book WHERE kind = 'snapshot' GROUP BY 1),
    levels AS (SELECT * FROM (SELECT b.symbol, b.side, b.price, arg_max(b.qty, b.n) AS qty FROM book b LEFT JOIN since s ON b.symbol = s.symbol WHERE b.n >= coalesce(s.since, 0) GROUP BY 1, 2, 3) WHERE qty > 0)"""


@query("g04_book_final", f"WITH {_FINAL} SELECT * FROM levels")
def book_final(v):
    return book.latest_levels(v("book"))


@query("g04_book_tops", """
    WITH e AS (SELECT *, count(*) FILTER (kind = 'snapshot') OVER (PARTITION BY symbol ORDER BY n) AS episode FROM book),
    o AS (SELECT a.symbol, a.n, b.side, b.price, arg_max(b.qty, b.n) AS qty FROM e a JOIN e b ON a.symbol = b.symbol AND a.episode = b.episode AND b.n <= a.n GROUP BY 1, 2, 3, 4)
    SELECT symbol, n, max(price) FILTER (side = 'B' AND qty > 0) AS best_bid, min(price) FILTER (side = 'A' AND qty > 0) AS best_ask FROM o GROUP BY 1, 2""")
def book_tops(v):
    return book.tops(v("book"), v.tasks("events"))


@query("h01_best_bid_ask", f"""WITH {_FINAL} SELECT symbol, max(price) FILTER (side = 'B') AS bid_price, arg_max(qty, price) FILTER (side = 'B') AS bid_qty, min(price) FILTER (side = 'A') AS ask_price, arg_min(qty, price) FILTER (side = 'A') AS ask_qty FROM levels GROUP BY 1""")
def best_bid_ask(v):
    return book.best(book.latest_levels(v("book")))


@query("h03_top_levels", f"""WITH {_FINAL} SELECT symbol, side, price, qty, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM levels QUALIFY rank <= 3""")
def top_levels(v):
    return joins.top_of_book(book.latest_levels(v("book")), 3)


@query("f11_depths", f"""WITH {_FINAL}, d AS (SELECT symbol, count(*) FILTER (side = 'B') AS bid_depth, count(*) FILTER (side = 'A') AS ask_depth FROM levels GROUP BY 1) SELECT *, bid_depth = 0 OR ask_depth = 0 AS one_sided FROM d""")
def depths(v):
    return book.depths(book.latest_levels(v("book")))


@query("f14_book_violations", """
    WITH l AS (SELECT symbol, side, CASE WHEN side = 'B' THEN price + CASE WHEN n % 50 = 7 THEN 900 ELSE 0 END ELSE price END AS price, CASE WHEN n % 40 = 3 THEN 0 ELSE 1 END AS qty FROM book WHERE n > 30),
    b AS (SELECT symbol, max(price) FILTER (side = 'B') AS best_bid, min(price) FILTER (side = 'A') AS best_ask, count(*) FILTER (qty <= 0) AS bad_qty FROM l GROUP BY 1)
    SELECT *, coalesce(best_bid >= best_ask, false) AS crossed FROM b WHERE coalesce(best_bid >= best_ask, false) OR bad_qty > 0""")
def book_violations(v):
    spoilt = F.when((F.col("side") == "B") & (F.col("n") % 50 == 7), F.col("price") + 900).otherwise(F.col("price"))
    return book.violations(v("book").where("n > 30").select("symbol", "side", spoilt.alias("price"), F.when(F.col("n") % 40 == 3, 0).otherwise(1).alias("qty")))


_BYTES = "list_transform(generate_series(0, 7), lambda i: ({x} >> (8 * i)::INT) & 255)"


_CHECKSUMS = f"""
    WITH {_FINAL}, v AS (SELECT symbol, max(final_id) AS update_id FROM deltas GROUP BY 1),
    s AS (SELECT symbol, list(price ORDER BY price DESC) FILTER (side = 'B') AS bp, list(qty ORDER BY price DESC) FILTER (side = 'B') AS bq, list(price ORDER BY price) FILTER (side = 'A') AS ap, list(qty ORDER BY price) FILTER (side = 'A') AS aq FROM levels GROUP BY 1),
    d AS (SELECT v.symbol, update_id, coalesce(len(bp), 0) AS bid_depth, coalesce(len(ap), 0) AS ask_depth,
          list_concat({_BYTES.format(x='update_id')}, flatten(list_transform(generate_series(1, coalesce(len(bp), 0)), lambda j: list_concat({_BYTES.format(x='bp[j]')}, {_BYTES.format(x='bq[j]')}))),
                      flatten(list_transform(generate_series(1, coalesce(len(ap), 0)), lambda j: list_concat({_BYTES.format(x='ap[j]')}, {_BYTES.format(x='aq[j]')})))) AS data FROM v JOIN s ON v.symbol = s.symbol)
    SELECT symbol, update_id, bid_depth::BIGINT AS bid_depth, ask_depth::BIGINT AS ask_depth,
           format('{{:016x}}', list_reduce(list_transform(data, lambda x: x::HUGEINT), lambda h, b: ((h - h % 256 + xor((h % 256)::BIGINT, b::BIGINT)::HUGEINT) * 1099511628211) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)::UBIGINT) AS checksum FROM d"""


@query("g16_book_checksums", _CHECKSUMS)
def book_checksums(v):
    versions = v("deltas").groupBy("symbol").agg(F.max("final_id").alias("update_id"))
    return book.checksums(book.latest_levels(v("book")), versions)


@query("g12_snapshot_check", f"""
    WITH {_FINAL}, other AS (SELECT symbol, side, CASE WHEN price % 11 = 0 THEN price + 1 ELSE price END AS price, qty FROM levels),
    a AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM levels QUALIFY rank <= 5),
    b AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM other QUALIFY rank <= 5)
    SELECT a.symbol, a.side, count(*) AS compared, count(*) FILTER (a.price <> b.price) AS mismatches FROM a JOIN b ON a.symbol = b.symbol AND a.side = b.side AND a.rank = b.rank GROUP BY 1, 2""")
def snapshot_check(v):
    levels = book.latest_levels(v("book"))
    other = levels.withColumn("price", F.when(F.col("price") % 11 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return joins.compare_levels(levels, other)


@query("e08_bridging_deltas", """
    WITH s AS (SELECT symbol, max(final_id) AS snapshot_id FROM deltas WHERE kind = 'snapshot' GROUP BY 1)
    SELECT d.symbol, d.n, d.first_id, d.final_id, s.snapshot_id, d.first_id <= s.snapshot_id + 1 AS bridges FROM deltas d JOIN s ON d.symbol = s.symbol WHERE d.kind = 'delta' AND d.final_id > s.snapshot_id""")
def bridging_deltas(v):
    d = v("deltas")
    s = d.where("kind = 'snapshot'").groupBy("symbol").agg(F.max("final_id").alias("snapshot_id"))
    return joins.bridging(d.where("kind = 'delta'"), s).select("symbol", "n", "first_id", "final_id", "snapshot_id", "bridges")


@query("e09_untracked_fills", """SELECT f.trade_id, f.order_id, f.qty, f.price FROM fills f LEFT JOIN (SELECT * FROM requests WHERE order_id % 4 <> 0) r ON f.order_id = r.order_id WHERE r.order_id IS NULL""")
def untracked_fills(v):
    return joins.untracked_fills(v("fills"), v("requests").where("order_id % 4 <> 0")).select("trade_id", "order_id", "qty", "price")


_TABLES_OF = "CASE event_type WHEN 'purchase' THEN 'trades' WHEN 'view' THEN 'best_bid_offers' WHEN 'signup' THEN 'mark_prices' WHEN 'error' THEN 'liquidations' ELSE 'book_deltas' END"
_REQUIRED = ("trades", "book_deltas", "best_bid_offers", "mark_prices", "liquidations")
_MISSING = f"""SELECT d.symbol, n.name FROM (SELECT DISTINCT symbol FROM ticks) AS d CROSS JOIN (SELECT unnest({list(_REQUIRED)}) AS name) AS n
    WHERE NOT EXISTS (SELECT 1 FROM ticks AS t WHERE t.k < 3 AND t.symbol = d.symbol AND {_TABLES_OF} = n.name)"""


def _tables(v):
    """The destinations, and the tables that rows of low k have made in them."""
    ticks = v("ticks").select("symbol", "k", F.expr(_TABLES_OF).alias("name"))
    return ticks.select("symbol").distinct(), ticks.where("k < 3").select("symbol", "name").distinct()


@query("e12_missing_tables", _MISSING)
def missing_tables(v):
    return joins.missing_names(*_tables(v), "symbol", _REQUIRED)


@query("e13_orders_with_fills", """
    SELECT r.order_id, coalesce(list_sort(list(f.trade_id) FILTER (f.trade_id IS NOT NULL)), []) AS trade_ids, count(f.trade_id) AS n, coalesce(sum(f.qty), 0)::BIGINT AS filled FROM requests r LEFT JOIN fills f ON r.order_id = f.order_id GROUP BY 1""")
def orders_with_fills(v):
    o = joins.orders_with_fills(v("requests"), v("fills"))
    zero = F.lit(0).cast("long")
    return o.select("order_id", F.transform("fills", lambda f: f["trade_id"]).alias("trade_ids"), F.size("fills").cast("long").alias("n"), F.aggregate("fills", zero, lambda a, f: a + f["qty"]).alias("filled"))


@query("f01_counters", """SELECT count(*) AS messages_in, count(*) FILTER (event_type <> 'error') AS messages_out, count(*) FILTER (event_type = 'error' AND k < 10) AS decode_errors, count(*) FILTER (k = 11) AS gaps FROM ticks""")
def counters(v):
    error = F.col("event_type") == "error"
    return v("ticks").agg(F.count(F.lit(1)).alias("messages_in"), F.count_if(~error).alias("messages_out"), F.count_if(error & (F.col("k") < 10)).alias("decode_errors"), F.count_if(F.col("k") == 11).alias("gaps"))


@query("f02_counts_by_type", """SELECT ts_ns // 86400000000000 AS day, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM ticks GROUP BY 1""")
def counts_by_type(v):
    day = S.div(F.col("ts_ns"), F.lit(86_400_000_000_000)).alias("day")
    return v("ticks").groupBy(day).pivot("event_type", ["view", "click", "error"]).agg(F.count(F.lit(1))).fillna(0)


@query("f03_symbol_counters", """SELECT symbol, count(*) AS messages, count(*) FILTER (event_type = 'purchase') AS trades, count(*) FILTER (k = 11) AS gaps, max(ts_ns) AS last_ts FROM ticks GROUP BY 1""")
def symbol_counters(v):
    return v("ticks").groupBy("symbol").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("event_type") == "purchase").alias("trades"), F.count_if(F.col("k") == 11).alias("gaps"), F.max("ts_ns").alias("last_ts"))


_BOUNDS = ", ".join(f"({b})" for b in (*metrics.BOUNDS, metrics.OVERFLOW))
_HIST = f"""
    bounds(le) AS (VALUES {_BOUNDS}),
    b AS (SELECT event_type, latency_ns, (SELECT min(le) FROM bounds WHERE le >= latency_ns) AS le FROM latencies WHERE latency_ns >= 0),
    h AS (SELECT t.event_type, bounds.le::BIGINT AS le, count(b.latency_ns) AS n, coalesce(sum(b.latency_ns), 0)::BIGINT AS total FROM (SELECT DISTINCT event_type FROM b) t CROSS JOIN bounds LEFT JOIN b ON b.event_type = t.event_type AND b.le = bounds.le GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le)::BIGINT AS cumulative FROM h)"""


@query("f04_latency_histogram", f"WITH {_HIST} SELECT event_type, le, n, total, cumulative FROM c")
def latency_histogram(v):
    return metrics.histogram(v("latencies"), "latency_ns", ["event_type"])


@query("f06_bucket_percentiles", f"""
    WITH {_HIST}, p(p) AS (VALUES (50.0::DOUBLE), (90.0), (99.0), (99.9))
    SELECT event_type, p, min(le) FILTER (cumulative >= ceil(size * p / 100.0)) AS bound FROM (SELECT *, max(cumulative) OVER (PARTITION BY event_type) AS size FROM c) CROSS JOIN p GROUP BY 1, 2""")
def bucket_percentiles(v):
    return metrics.bucket_percentiles(metrics.histogram(v("latencies"), "latency_ns", ["event_type"]), ["event_type"], [50, 90, 99, 99.9])


@query("f07_exact_percentiles", """
    SELECT event_type, count(*) AS n, quantile_disc(latency_ns, 0.5) AS p50, quantile_disc(latency_ns, 0.99) AS p99, quantile_disc(latency_ns, 0.999) AS p999, max(latency_ns) AS largest FROM latencies WHERE latency_ns > 0 GROUP BY 1""")
def exact_percentiles(v):
    return metrics.nearest_rank(v("latencies"), "latency_ns", ["event_type"], {"p50": 0.5, "p99": 0.99, "p999": 0.999})


@query("f08_message_rates", """SELECT event_type, ts_ns - ts_ns % 3600000000000 AS start_ns, count(*) AS n, count(*) / 3600.0::DOUBLE AS per_second FROM ticks GROUP BY 1, 2""")
def message_rates(v):
    return metrics.rates(v("ticks"), "ts_ns", ["event_type"], 3600)


@query("a20_prometheus_text", f"""
    WITH {_HIST} SELECT 'latency_ns_bucket{{event_type="' || event_type || '",le="' || CASE WHEN le = {metrics.OVERFLOW} THEN '+Inf' ELSE le::VARCHAR END || '"}} ' || cumulative AS line FROM c
    UNION ALL SELECT 'latency_ns_sum{{event_type="' || event_type || '"}} ' || sum(total)::BIGINT FROM c GROUP BY event_type
    UNION ALL SELECT 'latency_ns_count{{event_type="' || event_type || '"}} ' || sum(n)::BIGINT FROM c GROUP BY event_type""".replace("{{", "{").replace("}}", "}"))
def prometheus_text(v):
    return metrics.prometheus_text(metrics.histogram(v("latencies"), "latency_ns", ["event_type"]), "latency_ns", ["event_type"])


@query("f12_cumulative_fills", """
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY order_id, trade_id ORDER BY ord) AS r FROM fills), o AS (SELECT order_id, trade_id, ord, qty FROM d WHERE r = 1)
    SELECT order_id, trade_id, qty, sum(qty) OVER (PARTITION BY order_id ORDER BY ord)::BIGINT AS filled, sum(qty) OVER (PARTITION BY order_id ORDER BY ord) >= 10000 AS is_final FROM o""")
def cumulative_fills(v):
    once = v("fills").groupBy("order_id", "trade_id").agg(F.min(F.struct("ord", "qty")).alias("f")).select("order_id", "trade_id", "f.*")
    filled = F.sum("qty").over(Window.partitionBy("order_id").orderBy("ord"))
    return once.select("order_id", "trade_id", "qty", filled.alias("filled"), (filled >= 10_000).alias("is_final"))


@query("f13_highest_counter", """SELECT instance, max(counter) AS highest, count(*) AS orders, count(*) FILTER (status = 'O') AS open_orders FROM requests GROUP BY 1""")
def highest_counter(v):
    made = v("requests").withColumn("cloid", S.order_id(F.col("instance"), F.col("counter")))
    return made.groupBy(S.order_instance(F.col("cloid")).alias("instance")).agg(F.max(S.order_counter(F.col("cloid"))).alias("highest"), F.count(F.lit(1)).alias("orders"), F.count_if(F.col("status") == "O").alias("open_orders"))


@query("g09_refdata_changes", """
    WITH m AS (SELECT *, lag((base_asset, quote_asset, tick_size, min_notional, is_trading)) OVER w AS before, lag(is_trading) OVER w AS traded, row_number() OVER w = 1 AS fresh FROM definitions WINDOW w AS (PARTITION BY symbol ORDER BY version))
    SELECT symbol, version, CASE WHEN fresh THEN 'Added' ELSE 'Updated' END AS change, fresh OR traded IS DISTINCT FROM is_trading AS status_event FROM m
    WHERE fresh OR before IS DISTINCT FROM (base_asset, quote_asset, tick_size, min_notional, is_trading)""")
def refdata_changes(v):
    return refdata.changes(v("definitions"), "version").select("symbol", "version", "change", "status_event")


@query("g10_latest_definitions", """SELECT symbol, version, tick_size, is_trading FROM definitions QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY version DESC) = 1""")
def latest_definitions(v):
    return refdata.latest(v("definitions").select("symbol", "version", "tick_size", "is_trading"), ["symbol"], "version")


@query("a15_broadcast_definitions", """SELECT symbol, shard_id, ord, CASE ord WHEN 0 THEN 'InstrumentDefinition' ELSE 'TradingStatus' END AS message, is_trading FROM instruments CROSS JOIN (SELECT unnest(generate_series(0, 3))::INT AS shard_id) CROSS JOIN (SELECT unnest([0, 1]) AS ord)""")
def broadcast_definitions(v):
    return refdata.to_shards(v("instruments").select("symbol", "is_trading"), 4).select("symbol", "shard_id", "ord", "message", "is_trading")


@query("g13_state_changes", """
    WITH s AS (SELECT symbol, event_id, ts_ns, CASE WHEN k < 10 THEN 'Stale' WHEN k < 25 THEN 'Degraded' ELSE 'Live' END AS state FROM ticks)
    SELECT symbol, event_id, state FROM (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS before FROM s) WHERE before IS DISTINCT FROM state""")
def state_changes(v):
    state = F.when(F.col("k") < 10, "Stale").when(F.col("k") < 25, "Degraded").otherwise("Live")
    before = F.lag("state").over(Window.partitionBy("symbol").orderBy("ts_ns", "event_id"))
    return v("ticks").withColumn("state", state).withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("state"))).select("symbol", "event_id", "state")


@query("g14_sequence_numbers", """SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) - 1 AS sequence_number FROM ticks WHERE event_type <> 'error'""")
def sequence_numbers(v):
    # unknown events are filtered first, so that they use up no number
    return v("ticks").where("event_type <> 'error'").select("symbol", "event_id", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ns", "event_id")) - 1).cast("long").alias("sequence_number"))


@query("g21_heartbeat_gaps", """SELECT symbol, event_id, gap_ns FROM (SELECT *, lead(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) - ts_ns AS gap_ns FROM ticks) WHERE gap_ns > 36000000000000""")
def heartbeat_gaps(v):
    return folds.heartbeat_gaps(v("ticks"), "symbol", 36_000_000_000_000).select("symbol", "event_id", "gap_ns")


@query("g23_listen_key_age", """SELECT symbol, event_id, CASE WHEN age >= 3600000000000 THEN 'expired' WHEN age >= 1800000000000 THEN 'renew' ELSE 'fresh' END AS state FROM (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS age FROM ticks)""")
def listen_key_age(v):
    age = F.col("ts_ns") - F.lag("ts_ns").over(Window.partitionBy("symbol").orderBy("ts_ns", "event_id"))
    minute = 60_000_000_000
    return v("ticks").withColumn("age", age).select("symbol", "event_id", F.when(F.col("age") >= 60 * minute, "expired").when(F.col("age") >= 30 * minute, "renew").otherwise("fresh").alias("state"))


@query("j05_stale_episodes", """
    WITH s AS (SELECT symbol, event_id, ts_ns, ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) > 14400000000000 AS far FROM ticks),
    e AS (SELECT *, count(*) FILTER (far) OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS episode FROM s)
    SELECT symbol, episode, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n FROM e GROUP BY 1, 2""")
def stale_episodes(v):
    by = Window.partitionBy("symbol").orderBy("ts_ns", "event_id")
    far = (F.col("ts_ns") - F.lag("ts_ns").over(by)) > 14_400_000_000_000
    e = v("ticks").withColumn("far", far).withColumn("episode", F.count_if("far").over(by))
    return e.groupBy("symbol", "episode").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count(F.lit(1)).alias("n"))


@query("j07_replay_times", """SELECT event_id, 1000 + ((ts_ns - (SELECT min(ts_ns) FROM ticks)) * 3) // 2 AS emit_at_ns FROM ticks""")
def replay_times(v):
    return replay.emit_times(v("ticks").withColumnRenamed("ts_ns", "captured_at_ns"), 1_000, 3, 2).select("event_id", "emit_at_ns")


@query("j10_conflation", """SELECT symbol, ts_ns // 86400000000000 AS day, arg_max(price, (ts_ns, event_id)) AS price FROM ticks GROUP BY 1, 2""")
def conflation(v):
    return v("ticks").groupBy("symbol", S.div(F.col("ts_ns"), F.lit(86_400_000_000_000)).alias("day")).agg(F.max_by("price", F.struct("ts_ns", "event_id")).alias("price"))


@query("i01_union_streams", """SELECT event_type, count(*) AS n, sum(price)::BIGINT AS total FROM ticks GROUP BY 1""")
def union_streams(v):
    # the streams of all shards are one table: each aggregates its own rows, and their results are united in one shuffle
    t = v("ticks").withColumn("shard", F.col("user_id") % 4)
    by_shard = t.groupBy("shard", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return by_shard.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("i02_distinct_trades", """SELECT order_id, count(DISTINCT trade_id) AS trades FROM fills GROUP BY 1""")
def distinct_trades(v):
    return v("fills").dropDuplicates(["order_id", "trade_id"]).groupBy("order_id").agg(F.count(F.lit(1)).alias("trades"))


@query("i03_updated_on_both", """SELECT symbol FROM bbo WHERE instance_id = 0 INTERSECT SELECT symbol FROM bbo WHERE instance_id = 1""")
def updated_on_both(v):
    b = v("bbo")
    return b.where("instance_id = 0").select("symbol").intersect(b.where("instance_id = 1").select("symbol"))


@query("i04_differences", """SELECT order_id FROM requests WHERE order_id % 3 = 0 EXCEPT SELECT order_id FROM requests WHERE status = 'F'""")
def differences(v):
    r = v("requests")
    return r.where("order_id % 3 = 0").select("order_id").exceptAll(r.where("status = 'F'").select("order_id"))


@query("i05_distinct_prices", """SELECT symbol, count(DISTINCT price) AS prices FROM book GROUP BY 1""")
def distinct_prices(v):
    return v("book").select("symbol", "price").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("prices"))


@query("b09_bus_round_trip", """SELECT symbol, trade_id, price, qty, trade_ts, is_buyer_maker, (CASE WHEN is_buyer_maker THEN 2 ELSE 1 END)::BIGINT AS aggressor_side, exchange_event_ts FROM trades""")
def bus_round_trip(v):
    frames = binary.encode(with_header(v("trades"), 6), 6)
    return binary.decode(frames, 6).select("symbol", "trade_id", "price", "qty", "trade_ts", "is_buyer_maker", "aggressor_side", "exchange_event_ts")


@query("b06_feed_round_trip", """SELECT symbol, n, first_id, final_id, prev_id, [price] AS bid_prices, [qty] AS ask_qtys FROM deltas""")
def feed_round_trip(v):
    level = F.array(F.struct("price", "qty"))
    d = v("deltas").select("symbol", F.col("n").alias("event_us"), F.lit(0).cast("long").alias("transact_us"), "first_id", "final_id", "prev_id", level.alias("bids"), level.alias("asks"))
    out = binary.from_feed(binary.to_feed(d, 3), 3)
    return out.select("symbol", F.col("event_us").alias("n"), "first_id", "final_id", "prev_id", F.transform("bids", lambda x: x["price"]).alias("bid_prices"), F.transform("asks", lambda x: x["qty"]).alias("ask_qtys"))


@query("b16_journal_records", """SELECT order_id, 19 + length(order_id::VARCHAR) + 1 AS bytes FROM requests""")
def journal_records(v):
    r = v("requests")
    none = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in journal.COLUMNS.split(", ")) if n not in ("tag", "timestamp_ns", "cloid", "exchange_id")]
    entries = r.select(F.lit(2).cast("long").alias("tag"), F.col("ts_ns").alias("timestamp_ns"), F.col("order_id").cast("string").alias("cloid"), F.col("order_id").alias("exchange_id"), *none)
    out = journal.encode_rows(entries)
    n = F.octet_length("record")
    return out.select(F.decode(F.expr("substring(record, 13, octet_length(record) - 20)"), "UTF-8").cast("long").alias("order_id"), n.cast("long").alias("bytes"))


@query("e10_shard_semi_join", """SELECT event_id, symbol, price FROM ticks WHERE user_id IN (SELECT DISTINCT user_id FROM ticks WHERE k = 3)""")
def shard_semi_join(v):
    owned = v("ticks").where("k = 3").select("symbol").distinct()
    return v("ticks").join(owned, "symbol", "left_semi").select("event_id", "symbol", "price")


@query("a18_sink_readiness", f"SELECT d.symbol, count(m.name) AS missing, count(m.name) = 0 AS ready FROM (SELECT DISTINCT symbol FROM ticks) AS d LEFT JOIN ({_MISSING}) AS m ON d.symbol = m.symbol GROUP BY 1")
def sink_readiness(v):
    sinks, present = _tables(v)
    missing = joins.missing_names(sinks, present, "symbol", _REQUIRED).groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"))
    n = F.coalesce("missing", F.lit(0))
    return sinks.join(missing, "symbol", "left").select("symbol", n.alias("missing"), (n == 0).alias("ready"))


@query("h02_ordered_levels", f"""WITH {_FINAL} SELECT symbol, list(price ORDER BY price DESC) FILTER (side = 'B') AS bids, list(price ORDER BY price) FILTER (side = 'A') AS asks FROM levels GROUP BY 1""")
def ordered_levels(v):
    levels = book.latest_levels(v("book"))
    sides = levels.groupBy("symbol").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("price"))), asc=s == "A").alias(n) for s, n in (("B", "bids"), ("A", "asks"))])
    return sides.select("symbol", *[F.when(F.size(n) > 0, F.col(n)).alias(n) for n in ("bids", "asks")])


@query("h06_symbol_report", """SELECT symbol, count(*) AS n, min(ts_ns) AS first_ts FROM ticks GROUP BY 1 ORDER BY 1""")
def symbol_report(v):
    return v("ticks").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts")).orderBy("symbol")


@query("j03_tumbling_windows", """SELECT event_type, ts_ns // 900000000000 * 900 AS start_s, count(*) AS n FROM ticks GROUP BY 1, 2""")
def tumbling_windows(v):
    t = v("ticks").withColumn("ts", F.timestamp_micros(S.div(F.col("ts_ns"), F.lit(1_000))))
    return t.groupBy("event_type", F.window("ts", "15 minutes")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_seconds("window.start").alias("start_s"), "n")


@query("j04_sliding_window", """SELECT symbol, event_id, max(price) OVER w AS highest, min(price) OVER w AS lowest, count(*) OVER w AS n FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""")
def sliding_window(v):
    w = Window.partitionBy("symbol").orderBy("ts_ns", "event_id").rowsBetween(-63, 0)
    return v("ticks").select("symbol", "event_id", F.max("price").over(w).alias("highest"), F.min("price").over(w).alias("lowest"), F.count(F.lit(1)).over(w).alias("n"))
