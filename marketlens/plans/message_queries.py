"""Queries of normalisers, recovery, routing and decoders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, scalars as S
from ..operators import book, folds, joins, landing, normalise, replay
from ..sources import binary, json_frames as J
from .catalog import query
from .fold_queries import _sequence_sql
from .scalar_queries import _frames, _text, with_header

_DAY = 86_400_000_000_000


def _scaled(rows, price: int = 2, qty: int = 0):
    return rows.withColumns({"price_scale": F.lit(price), "qty_scale": F.lit(qty)})


@query("c06_decimal_rescale", """SELECT event_id, price // CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS scaled FROM ticks""")
def decimal_rescale(v):
    scale = F.when(F.col("k") % 3 == 0, 8).when(F.col("k") % 3 == 1, 6).otherwise(4)
    return v("ticks").select("event_id", S.div(F.col("price"), S.pow10(F.lit(8) - scale)).alias("scaled"))


@query("c17_order_codes", """SELECT order_id, CASE WHEN order_id % 3 = 0 THEN 0 WHEN order_id % 3 = 1 THEN 1 END AS side, CASE WHEN order_id % 2 = 0 THEN 0 ELSE 1 END AS order_type, (order_id % 3)::INTEGER AS time_in_force FROM requests""")
def order_codes(v):
    side = F.when(F.col("order_id") % 3 == 0, "BUY").when(F.col("order_id") % 3 == 1, "SELL").otherwise("HOLD")
    kind = F.when(F.col("order_id") % 2 == 0, "LIMIT").otherwise("MARKET")
    tif = F.element_at(F.array(F.lit("GTC"), F.lit("IOC"), F.lit("FOK")), (F.col("order_id") % 3 + 1).cast("int"))
    return v("requests").select("order_id", codes.code_of(side, codes.ORDER_SIDES).alias("side"), codes.code_of(kind, codes.ORDER_TYPES).alias("order_type"), codes.code_of(tif, codes.TIMES_IN_FORCE).alias("time_in_force"))


@query("c28_code_names", """SELECT event_id, CASE k % 9 WHEN 1 THEN 'Connecting' WHEN 2 THEN 'Live' WHEN 3 THEN 'Degraded' WHEN 4 THEN 'Stale' WHEN 5 THEN 'Recovering' WHEN 6 THEN 'Recovered' WHEN 7 THEN 'Failed' END AS state FROM ticks""")
def code_names(v):
    return v("ticks").select("event_id", codes.name_of(F.col("k") % 9, codes.FEED_STATES).alias("state"))


@query("c31_spot_trades", """
    SELECT symbol, event_id, event_id AS trade_id, price * 100 AS price, k AS qty, ts_ns // 1000000 * 1000000 AS trade_ts, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS aggressor_side,
           row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts_ns, event_id) - 1 AS sequence_number FROM ticks WHERE event_type = 'purchase'""")
def spot_trades(v):
    ms = S.div(F.col("ts_ns"), F.lit(1_000_000))
    data = F.struct(ms.alias("E"), F.col("symbol").alias("s"), F.col("event_id").alias("t"), _text(F.col("price")).alias("p"), F.col("k").cast("string").alias("q"), ms.alias("T"), (F.col("k") % 2 == 0).alias("m"))
    ticks = v("ticks")
    frames = _frames(ticks, "trade", data, "purchase").join(ticks.select("event_id", "ts_ns", (F.col("user_id") % 4).alias("connection_id")), "event_id")
    t = normalise.trades(_scaled(J.parse(frames, "trade"), 4, 0))
    return normalise.with_header(t, 6, "connection_id", ["ts_ns", "event_id"], range_=S.div(F.col("ts_ns"), F.lit(_DAY))).select("symbol", "event_id", "trade_id", "price", "qty", "trade_ts", "aggressor_side", "sequence_number")


@query("c32_futures_depth", """
    SELECT symbol, event_id, k AS first_id, k + 3 AS final_id, k - 1 AS prev_id, [price, price + 1] AS bid_prices, [k, k] AS bid_qtys, ts_ns // 1000000 * 1000000 AS exchange_event_ts FROM ticks WHERE event_type = 'click'""")
def futures_depth(v):
    pair = lambda d: F.array(_text(F.col("price") + d), F.col("k").cast("string"))
    data = F.struct(S.div(F.col("ts_ns"), F.lit(1_000_000)).alias("E"), F.col("symbol").alias("s"), F.col("k").alias("U"), (F.col("k") + 3).alias("u"), (F.col("k") - 1).alias("pu"), F.array(pair(0), pair(1)).alias("b"), F.array(pair(2)).alias("a"))
    d = normalise.depth(_scaled(J.parse(_frames(v("ticks"), "depth", data, "click"), "depth", J.FUTURES)))
    return d.select("symbol", "event_id", "first_id", "final_id", "prev_id", F.transform("bids", lambda x: x["price"]).alias("bid_prices"), F.transform("bids", lambda x: x["qty"]).alias("bid_qtys"), "exchange_event_ts")


@query("c31_spot_quotes", """
    SELECT symbol, event_id, k AS update_id, price AS bid_price, k AS bid_qty, price + 1 AS ask_price, k + 2 AS ask_qty, 0 AS exchange_event_ts,
           row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts_ns, event_id) - 1 AS sequence_number FROM ticks WHERE event_type = 'view'""")
def spot_quotes(v):
    data = F.struct(F.col("k").alias("u"), F.col("symbol").alias("s"), _text(F.col("price")).alias("b"), F.col("k").cast("string").alias("B"), _text(F.col("price") + 1).alias("a"), (F.col("k") + 2).cast("string").alias("A"))
    ticks = v("ticks")
    frames = _frames(ticks, "bookTicker", data, "view").join(ticks.select("event_id", "ts_ns", (F.col("user_id") % 4).alias("connection_id")), "event_id")
    q = normalise.with_header(normalise.quotes(_scaled(J.parse(frames, "bookTicker"))), 5, "connection_id", ["ts_ns", "event_id"], range_=S.div(F.col("ts_ns"), F.lit(_DAY)))
    return q.select("symbol", "event_id", "update_id", "bid_price", "bid_qty", "ask_price", "ask_qty", "exchange_event_ts", "sequence_number")


@query("c32_futures_agg_trades", """
    SELECT symbol, event_id, event_id * 3 AS trade_id, price AS price, k AS qty, ts_ns // 1000000 * 1000000 AS exchange_event_ts, (ts_ns // 1000000 - 5) * 1000000 AS trade_ts, k % 3 = 0 AS is_buyer_maker,
           CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS aggressor_side FROM ticks WHERE event_type = 'purchase'""")
def futures_agg_trades(v):
    ms = S.div(F.col("ts_ns"), F.lit(1_000_000))
    data = F.struct(ms.alias("E"), F.col("symbol").alias("s"), (F.col("event_id") * 3).alias("a"), _text(F.col("price")).alias("p"), F.col("k").cast("string").alias("q"), (ms - 5).alias("T"), (F.col("k") % 3 == 0).alias("m"))
    t = normalise.trades(_scaled(J.parse(_frames(v("ticks"), "aggTrade", data, "purchase"), "aggTrade", J.FUTURES)))
    return t.select("symbol", "event_id", "trade_id", "price", "qty", "exchange_event_ts", "trade_ts", "is_buyer_maker", "aggressor_side")


@query("c32_futures_mark_prices", """
    WITH m AS (SELECT symbol, event_id, ts_ns // 1000000 * 1000000 AS exchange_event_ts, 7 AS message_type, price AS mark_price, CASE WHEN k % 4 = 0 THEN 0 ELSE price + 5 END AS index_price, NULL::BIGINT AS funding_rate, NULL::BIGINT AS next_funding_time FROM ticks WHERE event_type = 'signup'
      UNION ALL SELECT symbol, event_id, ts_ns // 1000000 * 1000000, 8, NULL, NULL, k * 10000000, (ts_ns // 1000000 + 28800000) * 1000000 FROM ticks WHERE event_type = 'signup' AND price % 10 <> 0)
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_id, message_type) - 1 AS sequence_number FROM m""")
def futures_mark_prices(v):
    ms = S.div(F.col("ts_ns"), F.lit(1_000_000))
    rate = F.when(F.col("price") % 10 == 0, "").otherwise(_text(F.col("k")))
    data = F.struct(ms.alias("E"), F.col("symbol").alias("s"), _text(F.col("price")).alias("p"), F.when(F.col("k") % 4 == 0, "").otherwise(_text(F.col("price") + 5)).alias("i"), rate.alias("r"), (ms + 28_800_000).alias("T"))
    m = normalise.mark_prices(_scaled(J.parse(_frames(v("ticks"), "markPrice", data, "signup"), "markPrice", J.FUTURES)))
    m = normalise.with_header(m, None, "symbol", ["event_id", "message_type"], market=2, range_=S.div(F.col("event_id"), F.lit(10_000)))
    return m.select("symbol", "event_id", "exchange_event_ts", "message_type", "mark_price", "index_price", "funding_rate", "next_funding_time", "sequence_number")


@query("c32_futures_liquidations", """SELECT symbol, event_id, CASE side_text WHEN 'BUY' THEN 0 ELSE 1 END AS side, price, price - 1 AS avg_price, qty, qty AS last_filled_qty FROM liquidations WHERE side_text <> 'NONE' AND price > 0""")
def futures_liquidations(v):
    order = F.struct(F.col("symbol").alias("s"), F.col("side_text").alias("S"), F.col("qty").cast("string").alias("q"), _text(F.col("price")).alias("p"), _text(F.col("price") - 1).alias("ap"), F.col("qty").cast("string").alias("l"))
    rows = v("liquidations").where("price > 0").withColumn("event_type", F.lit("error"))
    parsed = J.parse(_frames(rows, "forceOrder", F.struct(F.lit(1).alias("E"), order.alias("o")), "error"), "forceOrder", J.FUTURES)
    return normalise.liquidations(_scaled(parsed)).select("symbol", "event_id", "side", "price", "avg_price", "qty", "last_filled_qty")


@query("c34_binary_trades", """
    SELECT symbol, trade_id, price, qty, (trade_ts // 1000) * 1000 AS exchange_event_ts, CASE WHEN trade_id % 3 = 0 THEN 2 WHEN trade_id % 3 = 1 THEN 1 ELSE 0 END AS aggressor_side FROM trades""")
def binary_trades(v):
    us = S.div(F.col("trade_ts"), F.lit(1_000))
    t = v("trades").select("symbol", us.alias("event_us"), us.alias("transact_us"), "trade_id", (F.col("price") * 1_000_000 + 77).alias("price"), (F.col("qty") * 1_000_000).alias("qty"), F.lit(0).cast("long").alias("buyer_order_id"), F.lit(0).cast("long").alias("seller_order_id"), (F.col("trade_id") % 3).alias("aggressor_side"), "is_buyer_maker")
    out = binary.from_feed(binary.to_feed(t, 0), 0)
    return normalise.from_binary(_scaled(out, 2, 2), ("price",), ("qty",)).select("symbol", "trade_id", "price", "qty", "exchange_event_ts", "aggressor_side")


@query("c35_open_interest", """SELECT symbol, event_id, price * 10 AS open_interest, ts_ns // 1000000 * 1000000 AS exchange_event_ts FROM ticks""")
def open_interest(v):
    t = v("ticks").select("symbol", "event_id", _text(F.col("price")).alias("open_interest"), S.div(F.col("ts_ns"), F.lit(1_000_000)).alias("event_ms"))
    return normalise.open_interest(_scaled(t, 2, 3)).select("symbol", "event_id", "open_interest", "exchange_event_ts")


@query("c36_order_updates", """
    SELECT order_id, CASE WHEN order_id % 4 <> 0 THEN format('cc-{:04x}-{:016x}', instance, counter) END AS own_cloid, (order_id % 2)::INTEGER AS side, value AS last_fill_price, 3::BIGINT AS cum_fill_qty, 'TRADE' AS execution_type,
           CASE WHEN order_id % 3 = 0 THEN 'LOW' END AS reject_reason FROM requests""")
def order_updates(v):
    cloid = F.when(F.col("order_id") % 4 == 0, F.concat(F.lit("web_"), F.col("order_id").cast("string"))).otherwise(S.order_id(F.col("instance"), F.col("counter")))
    raw = v("requests").select(
        "order_id", cloid.alias("cloid"), F.when(F.col("order_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit("LIMIT").alias("order_type"), F.lit("GTC").alias("time_in_force"), F.lit("TRADE").alias("execution_type"),
        F.when(F.col("order_id") % 3 == 0, "LOW").otherwise("NONE").alias("reject_reason"), _text(F.col("value")).alias("last_fill_price"), F.lit("1").alias("last_fill_qty"), F.lit("3").alias("cum_fill_qty"), F.lit(-1).cast("long").alias("trade_id"), F.lit(5).cast("long").alias("event_ms"),
    )
    return normalise.order_updates(_scaled(raw)).select("order_id", "own_cloid", "side", "last_fill_price", "cum_fill_qty", "execution_type", "reject_reason")


@query("d02_universe", """SELECT symbol FROM instruments WHERE is_trading AND base_asset IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')""")
def universe(v):
    return v("instruments").where(F.col("is_trading") & F.col("base_asset").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")).select("symbol")


@query("d08_validation_candidates", """
    WITH l AS (SELECT symbol, side, price, arg_max(qty, n) AS qty FROM book GROUP BY 1, 2, 3),
    d AS (SELECT symbol, count(*) FILTER (side = 'B' AND qty > 0) AS b, count(*) FILTER (side = 'A' AND qty > 0) AS a FROM l GROUP BY 1) SELECT symbol FROM d WHERE b > 0 AND a > 0""")
def validation_candidates(v):
    whole = v("book").withColumn("kind", F.lit("delta"))
    return book.depths(book.latest_levels(whole)).where(~F.col("one_sided")).select("symbol")


@query("d09_active_role", """SELECT symbol, count(*) FILTER (instance_id = 0) AS active, count(*) FILTER (instance_id <> 0) AS passive FROM bbo GROUP BY 1""")
def active_role(v):
    active = F.col("instance_id") == 0
    return v("bbo").groupBy("symbol").agg(F.count_if(active).alias("active"), F.count_if(~active).alias("passive"))


_JUDGED = _sequence_sql("r.first_id", "1", ("f.last + 1", "r.first_id"))


@query("g03_last_valid_ids", _JUDGED.replace("SELECT r.symbol, r.n, r.first_id, r.final_id, f.result, f.expected, f.actual FROM f JOIN", "SELECT r.symbol, max(r.final_id) FILTER (f.result IN ('Apply', 'Snapshot')) AS last_valid FROM f JOIN") + " GROUP BY r.symbol")
def last_valid_ids(v):
    judged = folds.run(v("deltas"), folds.SPOT_SEQUENCE, "symbol", ["n"], tasks=v.tasks("events"))
    return judged.groupBy("symbol").agg(F.max(F.when(F.col("result").isin("Apply", "Snapshot"), F.col("final_id"))).alias("last_valid"))


def _over_judged(body: str) -> str:
    head, tail = _JUDGED.rsplit("SELECT r.symbol, r.n, r.first_id", 1)
    return head.rstrip() + ", j AS (SELECT r.symbol, r.n, r.kind, r.first_id" + tail + ") " + body


@query("g05_stale_books", _over_judged("""SELECT symbol, n, result, coalesce(last_value(CASE WHEN result IN ('Gap', 'Snapshot') THEN result END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n) = 'Gap', false) AS is_stale FROM j"""))
def stale_books(v):
    return normalise.staleness(v("deltas"), tasks=v.tasks("events"))


@query("g07_recoveries", _over_judged("""
    SELECT symbol, snapshot_id, count(*) FILTER (result = 'Apply') AS replayed, count(*) FILTER (result = 'Discard') AS discarded, count(*) FILTER (result = 'Gap') > 0 AS failed
    FROM (SELECT *, max(CASE WHEN kind = 'snapshot' THEN final_id END) OVER (PARTITION BY symbol ORDER BY n) AS snapshot_id FROM j) WHERE snapshot_id IS NOT NULL GROUP BY 1, 2"""))
def recoveries(v):
    return normalise.recovery_outcomes(v("deltas"), tasks=v.tasks("events"))


@query("g25_dead_sessions", """
    WITH p AS (SELECT symbol, event_id, ts_ns, CASE WHEN k % 3 = 0 THEN 'ping' ELSE 'pong' END AS kind FROM ticks WHERE k % 3 < 2)
    SELECT symbol, event_id FROM (SELECT *, lead(kind) OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS after FROM p) WHERE kind = 'ping' AND after = 'ping'""")
def dead_sessions(v):
    kind = F.when(F.col("k") % 3 == 0, "ping").when(F.col("k") % 3 == 1, "pong").otherwise("data")
    return normalise.dead_sessions(v("ticks").withColumn("kind", kind)).select("symbol", "event_id")


@query("a14_shard_routing", """
    SELECT event_id, CASE WHEN k < 90 THEN k % 8 + 1 END AS stream_id, CASE WHEN k >= 90 THEN 'unknown shard 99' END AS error FROM ticks""")
def shard_routing(v):
    messages = v("ticks").select("event_id", F.when(F.col("k") < 90, F.col("k") % 8).otherwise(F.lit(99)).alias("shard_id"))
    return landing.route(messages, "shard_id", 8).select("event_id", "stream_id", "error")


@query("c03_parse_scaled_power", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE trunc(cast(balance as decimal(15, 2)) * (CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100000000 END))::BIGINT END AS scaled FROM accounts""")
def parse_scaled_power(v):
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "balance"))
    factor = F.element_at(F.array(*[F.lit(10**i).cast("long") for i in (0, 1, 8)]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return v("accounts").select("c_custkey", S.parse_scaled_by(text, factor).alias("scaled"))


@query("d03_numbered_known_events", """
    SELECT event_id, cast(row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts_ns, event_id) - 1 as bigint) AS sequence_number FROM ticks WHERE event_type IN ('purchase', 'view')""")
def numbered_known_events(v):
    ticks = v("ticks").withColumn("connection", F.col("user_id") % 4)
    kind = F.when(F.col("event_type") == "purchase", "trade").when(F.col("event_type") == "view", "bookTicker").otherwise("kline_1m")
    frames = ticks.withColumn("payload", F.to_json(F.struct(F.concat("symbol", F.lit("@"), kind).alias("stream"), F.struct(F.col("symbol").alias("s")).alias("data"))))
    known = frames.where(J.stream_kind(F.col("payload")).isin(list(J.SPOT)))
    return normalise.with_header(known, 6, "connection", ["ts_ns", "event_id"], range_=S.div(F.col("ts_ns"), F.lit(_DAY))).select("event_id", "sequence_number")


@query("b07_decode_with_fallback", """SELECT event_id, CASE WHEN k % 4 < 2 THEN 'binary' WHEN k % 4 = 2 THEN 'json' ELSE 'error' END AS decoded_as, CASE WHEN k % 4 < 3 THEN symbol END AS symbol FROM ticks""")
def decode_with_fallback(v):
    t = v("ticks").select("event_id", "symbol", "k", F.col("event_id").alias("event_us"), F.lit(1).cast("long").alias("transact_us"), *[F.lit(1).cast("long").alias(c) for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")])
    two = binary.to_feed(t.where("k % 4 < 2"), 1)
    text = F.when(F.col("k") % 4 == 2, F.concat(F.lit('{"stream":"x@bookTicker","data":{"u":'), F.col("event_id").cast("string"), F.lit(',"s":"'), "symbol", F.lit('"}}'))).otherwise(F.concat(F.lit("broken "), F.col("event_id").cast("string")))
    frames = two.unionByName(t.where("k % 4 >= 2").select(F.encode(text, "UTF-8").alias("payload")))
    # frames that are no binary ones are tried as texts, each frame once
    read = binary.decode_feed(frames, 1)
    texts = read.where("feed is null").select(F.expr("try_validate_utf8(cast(payload as string))").alias("payload"))
    first = read.where("feed is not null").select(F.col("feed.event_us").alias("event_id"), F.col("feed.symbol").alias("symbol"))
    second = J.parse(texts.where("payload is not null"), "bookTicker").select(F.col("update_id").alias("event_id"), "symbol")
    found = first.withColumn("decoded_as", F.lit("binary")).unionByName(second.withColumn("decoded_as", F.lit("json")))
    return t.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("decoded_as", F.lit("error")).alias("decoded_as"), "symbol")


@query("b09_checksum_messages", """SELECT symbol, n AS update_id, 3::BIGINT AS bid_depth, cast(n as DOUBLE) AS checksum FROM deltas""")
def checksum_messages(v):
    d = with_header(v("deltas"), 18).withColumns({"instrument_id": F.lit(1), "sequence_number": F.col("n"), "exchange_event_ts": F.lit(0), "update_id": F.col("n"), "bid_depth": F.lit(3), "ask_depth": F.lit(4), "checksum": F.col("n")})
    return binary.decode(binary.encode(d, 18), 18).select("symbol", "update_id", "bid_depth", F.col("checksum").cast("double").alias("checksum"))


@query("b15_rest_orders", """SELECT order_id, CASE status WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'PARTIALLY_FILLED' ELSE 'FILLED' END AS status, value AS price, status <> 'F' AS is_live FROM requests""")
def rest_orders(v):
    status = F.when(F.col("status") == "O", "NEW").when(F.col("status") == "P", "PARTIALLY_FILLED").otherwise("FILLED")
    body = v("requests").select(F.to_json(F.struct(F.col("order_id").alias("orderId"), status.alias("status"), _text(F.col("value")).alias("price"))).alias("payload"))
    o = body.select(F.from_json("payload", "orderId long, status string, price string").alias("o")).select("o.*")
    return o.select(F.col("orderId").alias("order_id"), codes.known_or(F.col("status"), codes.REST_STATUSES).alias("status"), S.parse_scaled(F.col("price"), 2).alias("price"), F.col("status").isin(*codes.LIVE_STATUSES).alias("is_live"))


@query("e07_positional_pairs", """
    WITH l AS (SELECT symbol, side, price, max(qty) AS qty FROM book GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM l QUALIFY rank <= 4)
    SELECT symbol, side, count(*) AS compared, count(*) FILTER (qty % 2 = 1) AS mismatches FROM a GROUP BY 1, 2""")
def positional_pairs(v):
    levels = v("book").groupBy("symbol", "side", "price").agg(F.max("qty").alias("qty"))
    other = levels.withColumn("qty", F.when(F.col("qty") % 2 == 1, F.col("qty") + 10).otherwise(F.col("qty")))
    return joins.compare_levels(levels, other, 4, 0, check_qty=True)


@query("f16_order_counts", """SELECT instance, count(*) AS tracked, count(*) FILTER (status = 'O') AS pending FROM requests GROUP BY 1""")
def order_counts(v):
    return v("requests").groupBy("instance").agg(F.count(F.lit(1)).alias("tracked"), F.count_if(F.col("status") == "O").alias("pending"))


@query("f17_replay_statistics", """SELECT count(*) AS delivered, 0::BIGINT AS dropped, count(*) AS corrupted, count(*) AS duplicated FROM ticks""")
def replay_statistics(v):
    frames = v("ticks").select(F.col("symbol").alias("recording"), F.col("event_id").alias("frame_id"), F.col("ts_ns").alias("captured_at_ns"), F.encode("symbol", "UTF-8").alias("payload"))
    return replay.statistics(replay.inject(frames, 0, 100, 100, 9), frames)


@query("h04_table_order", """SELECT symbol, exchange_event_ts, trade_id, row_number() OVER (PARTITION BY symbol ORDER BY exchange_event_ts, trade_id, price, qty, trade_ts) AS place FROM trades""")
def table_order(v):
    by = Window.partitionBy("symbol").orderBy("exchange_event_ts", "trade_id", "price", "qty", "trade_ts")
    return v("trades").withColumn("place", F.row_number().over(by).cast("long")).select("symbol", "exchange_event_ts", "trade_id", "place")


@query("h07_first_samples", """SELECT symbol, event_id FROM ticks ORDER BY ts_ns, event_id LIMIT 5""")
def first_samples(v):
    return v("ticks").orderBy("ts_ns", "event_id").limit(5).select("symbol", "event_id")
