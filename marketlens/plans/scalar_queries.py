"""Queries of scalar functions, filters and landing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, scalars as S
from ..operators import landing, numbering
from ..sources import json_frames as J
from .catalog import query

_FNV = "list_reduce(list_transform(generate_series(1, strlen(x)), lambda i: ascii(x[i])::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, {start}::BIGINT)"
_FNV_START = 2166136261
_SHARD_START = (((2166136261 ^ 1) * 16777619 & 0xFFFFFFFF) ^ 1) * 16777619 & 0xFFFFFFFF


@query("a03_stream_names", """SELECT symbol, lower(symbol) || '@bookTicker' AS quote, lower(symbol) || '@depth@100ms' AS depth, lower(symbol) || '@trade' AS trade FROM instruments""")
def stream_names(v):
    return v("instruments").select("symbol", *[S.stream_name(F.col("symbol"), k).alias(n) for n, k in (("quote", "bookTicker"), ("depth", "depth@100ms"), ("trade", "trade"))])


@query("a04_futures_stream_names", """SELECT symbol, lower(symbol) || '@aggTrade' AS trade, lower(symbol) || '@markPrice@1s' AS mark, lower(symbol) || '@forceOrder' AS liquidation FROM instruments""")
def futures_stream_names(v):
    return v("instruments").select("symbol", *[S.stream_name(F.col("symbol"), k).alias(n) for n, k in (("trade", "aggTrade"), ("mark", "markPrice@1s"), ("liquidation", "forceOrder"))])


@query("a05_subscription_chunks", """
    WITH c AS (SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1) // 200 AS connection FROM instruments)
    SELECT connection, count(*) AS streams, string_agg(lower(symbol) || '@trade', '/' ORDER BY symbol) AS path FROM c GROUP BY 1""")
def subscription_chunks(v):
    numbered = numbering.numbered(v("instruments").select("symbol"), [], ["symbol"], F.substring("symbol", 1, 3))
    names = F.sort_array(F.collect_list(F.struct("symbol", S.stream_name(F.col("symbol"), "trade").alias("name"))))
    return numbered.groupBy(S.div(F.col("number"), F.lit(200)).alias("connection")).agg(F.count(F.lit(1)).alias("streams"), F.array_join(F.transform(names, lambda x: x["name"]), "/").alias("path"))


@query("c01_parse_scaled", """
    SELECT c_custkey, cast(round(cast(balance as decimal(15,2)) * 100) as bigint) AS cents,
           cast(trunc(cast(balance as decimal(15,2)) * 10) as bigint) AS tenths, cast(cast(balance as decimal(15,2)) * 100 as bigint) * 1000000 AS e8 FROM accounts""")
def parse_scaled(v):
    b = F.col("balance")
    return v("accounts").select("c_custkey", S.parse_scaled(b, 2).alias("cents"), S.parse_scaled(b, 1).alias("tenths"), S.parse_scaled(b, 8).alias("e8"))


@query("c02_parse_scaled_strict", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(cast(balance as decimal(15,2)) * 100 as bigint) END AS cents FROM accounts""")
def parse_scaled_strict(v):
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("."), F.substring_index("balance", ".", -1))).otherwise(F.col("balance"))
    return v("accounts").select("c_custkey", S.parse_scaled(text, 2, empty_integer_is_zero=False).alias("cents"))


@query("c04_derive_scale", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 4 END AS scale FROM accounts""")
def derive_scale(v):
    return v("accounts").select("c_custkey", S.derive_scale(F.when(F.col("c_custkey") % 2 == 0, F.col("balance")).otherwise(F.concat("balance", F.lit("00")))).alias("scale"))


@query("c05_rescale", """SELECT trade_id, price, qty, price * 1000000 AS d8, price // 100 AS whole, CASE WHEN price % 2 = 0 THEN 1 ELSE -1 END * (price // 10) AS signed_d1 FROM trades""")
def rescale(v):
    p = F.col("price")
    return v("trades").select("trade_id", "price", "qty", S.rescale(p, F.col("price_scale")).alias("d8"), S.rescale(p, F.col("price_scale"), 0).alias("whole"), S.rescale(F.when(p % 2 == 0, p).otherwise(-p), 2, 1).alias("signed_d1"))


@query("c07_time_units", """SELECT trade_id, (trade_ts // 1000000) * 1000000 AS from_ms, (trade_ts // 1000) * 1000 AS from_us FROM trades""")
def time_units(v):
    ts = F.col("trade_ts")
    return v("trades").select("trade_id", S.ms_to_ns(S.div(ts, F.lit(1_000_000))).alias("from_ms"), S.us_to_ns(S.div(ts, F.lit(1_000))).alias("from_us"))


@query("c08_instrument_id", f"""SELECT symbol, {_FNV.format(start=_FNV_START).replace('x', 'symbol').replace('symbolor', 'xor')} AS instrument_id FROM instruments""")
def instrument_id(v):
    return v("instruments").select("symbol", S.instrument_id(F.col("symbol")).alias("instrument_id"))


@query("c09_shards", f"""
    WITH s AS (SELECT symbol, {_FNV.format(start=_SHARD_START).replace('x', 'symbol').replace('symbolor', 'xor')} % 16 AS shard_id FROM instruments)
    SELECT symbol, shard_id, shard_id + 1 AS stream_id, shard_id + 1001 AS shadow_stream_id, shard_id % 3 AS owner FROM s""")
def shards(v):
    s = S.shard_of(F.col("symbol"), 16)
    return v("instruments").select("symbol", s.alias("shard_id"), S.stream_of(s).alias("stream_id"), S.stream_of(s, True).alias("shadow_stream_id"), S.owner_of(s, 3).alias("owner"))


@query("c13_header_scan", """
    SELECT trade_id, 1::BIGINT AS schema_version, 6::BIGINT AS message_type, trade_id % 4294967296 AS instrument_id, trade_id AS sequence_number, exchange_event_ts FROM trades""")
def header_scan(v):
    from ..sources import binary

    frames = binary.encode(with_header(v("trades"), 6), 6)
    return binary.headers(frames).select(F.col("sequence_number").alias("trade_id"), "schema_version", "message_type", "instrument_id", "sequence_number", "exchange_event_ts")


def with_header(rows, message_type: int):
    """Rows with constant header columns around their own ids and times, and the codes that the type asks for."""
    fixed = {"schema_version": 1, "message_type": message_type, "venue_id": 1, "market_type": 1, "connection_id": 7, "instance_id": 0, "exchange_tx_ts": 0, "local_recv_ts": 20, "local_publish_ts": 30}
    out = rows.withColumns({k: F.lit(x) for k, x in fixed.items()})
    if message_type == 6:
        out = out.withColumns({"instrument_id": F.col("trade_id") % 4294967296, "sequence_number": F.col("trade_id"), "aggressor_side": S.aggressor_side(F.col("is_buyer_maker"))})
    return out


@query("c14_aggressor_side", """SELECT trade_id, CASE WHEN is_buyer_maker THEN 2 ELSE 1 END AS side, CASE WHEN is_buyer_maker THEN 'Sell' ELSE 'Buy' END AS name, CASE WHEN trade_id % 3 = 0 THEN 2 WHEN trade_id % 3 = 1 THEN 1 ELSE 0 END AS from_binary FROM trades""")
def aggressor_side(v):
    side = S.aggressor_side(F.col("is_buyer_maker"))
    return v("trades").select("trade_id", side.alias("side"), codes.name_of(side, codes.AGGRESSORS).alias("name"), codes.from_binary_side(F.col("trade_id") % 3).alias("from_binary"))


@query("c16_liquidation_side", """SELECT event_id, side_text, CASE side_text WHEN 'BUY' THEN 0 WHEN 'SELL' THEN 1 END AS side FROM liquidations""")
def liquidation_side(v):
    return v("liquidations").select("event_id", "side_text", codes.code_of(F.col("side_text"), codes.ORDER_SIDES).alias("side"))


@query("c18_status_classes", """
    SELECT order_id, CASE status WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'PARTIALLY_FILLED' ELSE 'Unknown' END AS rest_status, status IN ('O', 'P') AS is_live FROM requests""")
def status_classes(v):
    raw = F.when(F.col("status") == "O", "NEW").when(F.col("status") == "P", "PARTIALLY_FILLED").otherwise("SOMETHING")
    return v("requests").select("order_id", codes.known_or(raw, codes.REST_STATUSES).alias("rest_status"), raw.isin(*codes.LIVE_STATUSES).alias("is_live"))


@query("c19_order_ids", """
    SELECT order_id, format('cc-{:04x}-{:016x}', instance, counter) AS cloid, instance AS parsed_instance, counter AS parsed_counter, cast(NULL as bigint) AS foreign_counter FROM requests""")
def order_ids(v):
    made = v("requests").withColumn("cloid", S.order_id(F.col("instance"), F.col("counter")))
    return made.select("order_id", "cloid", S.order_instance(F.col("cloid")).alias("parsed_instance"), S.order_counter(F.col("cloid")).alias("parsed_counter"), S.order_counter(F.concat(F.lit("x"), "cloid")).alias("foreign_counter"))


@query("c21_bps_and_percent", """
    SELECT update_id, CASE WHEN bid_price = 0 THEN 0 ELSE trunc(abs(bid_price - ask_price) * 10000 / abs(bid_price))::BIGINT * sign(bid_price)::BIGINT END AS spread_bps,
           CASE WHEN bid_qty = 0 THEN 0.0 ELSE 100.0 * ask_qty / bid_qty END::DOUBLE AS ratio FROM bbo""")
def bps_and_percent(v):
    return v("bbo").select("update_id", S.bps(F.col("bid_price"), F.col("ask_price")).alias("spread_bps"), S.percentage(F.col("ask_qty"), F.col("bid_qty")).alias("ratio"))


@query("c23_backoff", """SELECT event_id, k, least(1000 * (1 << least(greatest(k - 1, 0), 6)::INT), 30000)::BIGINT AS wait_ms FROM ticks""")
def backoff(v):
    return v("ticks").select("event_id", "k", S.backoff_ms(F.col("k")).alias("wait_ms"))


@query("c24_latency_legs", """
    SELECT trade_id, trade_ts - exchange_event_ts AS wire, CASE WHEN trade_id % 5 = 0 THEN NULL ELSE exchange_event_ts + 20000 - trade_ts END AS processing FROM trades""")
def latency_legs(v):
    published = F.when(F.col("trade_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("exchange_event_ts") + 20_000)
    return v("trades").select("trade_id", S.latency(F.col("trade_ts"), F.col("exchange_event_ts")).alias("wire"), S.latency(published, F.col("trade_ts")).alias("processing"))


@query("c25_human_units", """
    SELECT event_id, CASE WHEN l < 1000 THEN l || ' ns' WHEN l < 1000000 THEN printf('%.1f us', l / 1e3) WHEN l < 1000000000 THEN printf('%.2f ms', l / 1e6) ELSE printf('%.3f s', l / 1e9) END AS shown
    FROM (SELECT event_id, k * k * k * 1024 AS l FROM ticks)""")
def human_units(v):
    k = F.col("k")
    return v("ticks").select("event_id", S.human_ns(k * k * k * 1024).alias("shown"))


@query("c26_level_arrays", """SELECT update_id, [bid_price * 1000000, ask_price * 1000000] AS prices, [bid_qty, ask_qty] AS qtys FROM bbo""")
def level_arrays(v):
    def text(c):
        return F.concat(((F.col(c) - F.col(c) % 100) / 100).cast("long").cast("string"), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))

    pairs = F.array(F.array(text("bid_price"), F.col("bid_qty").cast("string")), F.array(text("ask_price"), F.col("ask_qty").cast("string")))
    made = v("bbo").select("update_id", S.levels(pairs, 8, 0).alias("l"))
    return made.select("update_id", F.transform("l", lambda x: x["price"]).alias("prices"), F.transform("l", lambda x: x["qty"]).alias("qtys"))


@query("c29_reject_reasons", """SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN NULL ELSE 'BAD_' || k END AS reason, CASE WHEN k < 50 THEN NULL ELSE k - 50 END AS trade_id FROM ticks""")
def reject_reasons(v):
    raw = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "NONE").otherwise(F.concat(F.lit("BAD_"), F.col("k").cast("string")))
    return v("ticks").select("event_id", codes.reject_reason(raw).alias("reason"), codes.trade_id(F.col("k") - 50).alias("trade_id"))


@query("c30_balances", """SELECT c_custkey, cast(cast(balance as decimal(15,2)) * 100 as bigint) * 1000000 AS free, -cast(cast(balance as decimal(15,2)) * 100 as bigint) * 1000000 AS delta FROM accounts""")
def balances(v):
    opposite = F.when(F.col("balance").startswith("-"), F.substr("balance", F.lit(2))).otherwise(F.concat(F.lit("-"), "balance"))
    return v("accounts").select("c_custkey", S.parse_scaled(F.col("balance"), 8).alias("free"), S.parse_scaled(opposite, 8).alias("delta"))


_MARK_TEXT = "CASE WHEN mark % 10 = 0 THEN '' ELSE cast(cast(k as decimal(9,4)) / 10000 as varchar) END"


@query("c33_mark_and_funding", """
    SELECT symbol, ts_ns, 7 AS message_type, mark * 1000000 AS value, CASE WHEN k % 4 = 0 THEN 0 ELSE (mark + 5) * 1000000 END AS second FROM marks
    UNION ALL SELECT symbol, ts_ns, 8, CASE WHEN k % 2 = 0 THEN k ELSE -k END * 100000, ts_ns + 28800000000000 FROM marks WHERE mark % 10 <> 0""")
def mark_and_funding(v):
    def cents(c):
        return F.concat(((c - c % 100) / 100).cast("long").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))

    rate = F.concat(F.when(F.col("k") % 2 == 0, "").otherwise("-"), F.lit("0."), F.lpad(F.col("k").cast("string"), 4, "0"))
    texts = v("marks").withColumns({"mark_text": cents(F.col("mark")), "index_text": F.when(F.col("k") % 4 == 0, "").otherwise(cents(F.col("mark") + 5)), "rate_text": F.when(F.col("mark") % 10 == 0, "").otherwise(rate), "next_funding_ns": F.col("ts_ns") + 28_800_000_000_000})
    return landing.mark_and_funding(texts)


@query("d01_owned_symbols", f"""SELECT symbol FROM instruments WHERE ({_FNV.format(start=_SHARD_START).replace('x', 'symbol').replace('symbolor', 'xor')} % 16) % 4 = 1 AND is_trading""")
def owned_symbols(v):
    return v("instruments").where((S.owner_of(S.shard_of(F.col("symbol"), 16), 4) == 1) & F.col("is_trading")).select("symbol")


@query("d04_positive_levels", """SELECT symbol, n, side, price, qty FROM book WHERE qty > 0""")
def positive_levels(v):
    folded = v("book").groupBy("symbol", "n").agg(F.collect_list(F.struct("side", "price", "qty")).alias("levels"))
    return folded.select("symbol", "n", F.inline(F.filter("levels", lambda x: x["qty"] > 0)))


@query("d06_latency_samples", """SELECT count(*) FILTER (latency_ns >= 0) AS histogram_samples, count(*) FILTER (latency_ns > 0) AS report_samples FROM latencies""")
def latency_samples(v):
    return v("latencies").agg(F.count_if(F.col("latency_ns") >= 0).alias("histogram_samples"), F.count_if(F.col("latency_ns") > 0).alias("report_samples"))


@query("d11_open_orders", """SELECT order_id, status FROM requests WHERE status NOT IN ('F')""")
def open_orders(v):
    state = F.when(F.col("status") == "F", "Filled").otherwise("New")
    return v("requests").where(~state.isin(*codes.TERMINAL)).select("order_id", "status")


@query("a19_trade_rows", """
    SELECT symbol, trade_id, cast(price as double) / 100 AS price, cast(qty as double) / 100 AS qty, trade_ts, exchange_event_ts, is_buyer_maker, CASE WHEN is_buyer_maker THEN 2 ELSE 1 END AS aggressor_side FROM trades""")
def trade_rows(v):
    rows = landing.trade_rows(v("trades"))
    return rows.select("symbol", "trade_id", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), "trade_ts", "exchange_event_ts", "is_buyer_maker", "aggressor_side")


@query("a19_bbo_rows", """SELECT symbol, instance_id, update_id, ts_ns, cast(bid_price as double) / 100 AS bid_price, cast(bid_qty as double) AS bid_qty, cast(ask_price as double) / 100 AS ask_price, cast(ask_qty as double) AS ask_qty FROM bbo""")
def bbo_rows(v):
    return landing.bbo_rows(v("bbo")).withColumns({c: F.col(c).cast("double") for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")})


@query("a19_mark_and_funding_rows", """
    SELECT symbol, event_id, cast(mark as double) / 100 AS mark_price, cast(mark + 5 as double) / 100 AS index_price, cast(k as double) / 10000 AS funding_rate FROM marks""")
def mark_and_funding_rows(v):
    m = v("marks").select("symbol", "event_id", F.col("mark").alias("mark_price"), (F.col("mark") + 5).alias("index_price"), F.lit(2).alias("price_scale"), (F.col("k") * 100_000).alias("funding_rate"), F.lit(9).alias("funding_rate_scale"))
    return landing.funding_rows(landing.mark_rows(m)).withColumns({c: F.col(c).cast("double") for c in ("mark_price", "index_price", "funding_rate")})


@query("a19_liquidation_rows", """SELECT symbol, event_id, CASE side_text WHEN 'BUY' THEN 0 ELSE 1 END AS side, cast(price as double) / 100 AS price, cast(price - 1 as double) / 100 AS avg_price, cast(qty as double) AS qty, cast(qty as double) AS last_filled_qty FROM liquidations WHERE side_text <> 'NONE'""")
def liquidation_rows(v):
    rows = v("liquidations").withColumn("side", codes.code_of(F.col("side_text"), codes.ORDER_SIDES)).where(F.col("side").isNotNull())
    rows = rows.select("symbol", "event_id", "side", "price", (F.col("price") - 1).alias("avg_price"), "qty", F.col("qty").alias("last_filled_qty"), F.lit(2).alias("price_scale"), F.lit(0).alias("qty_scale"))
    return landing.liquidation_rows(rows).withColumns({c: F.col(c).cast("double") for c in ("price", "avg_price", "qty", "last_filled_qty")})


@query("a19_delta_rows", """
    SELECT symbol, n, list(price / 100.0 ORDER BY price, qty) FILTER (side = 'B') AS bid_prices, list(qty::DOUBLE ORDER BY price, qty) FILTER (side = 'B') AS bid_qtys,
           list(price / 100.0 ORDER BY price, qty) FILTER (side = 'A') AS ask_prices, list(qty::DOUBLE ORDER BY price, qty) FILTER (side = 'A') AS ask_qtys FROM book GROUP BY 1, 2""")
def delta_rows(v):
    def side(name):
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("price", "qty"))))

    d = v("book").groupBy("symbol", "n").agg(side("B").alias("bids"), side("A").alias("asks")).withColumns({"price_scale": F.lit(2), "qty_scale": F.lit(0)})
    rows = landing.delta_rows(d)
    arrays = ("bid_prices", "bid_qtys", "ask_prices", "ask_qtys")
    return rows.select("symbol", "n", *[F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("double"))).alias(c) for c in arrays])


@query("a19_instrument_rows", """SELECT symbol, base_asset, quote_asset, cast(tick_size as double) / 100 AS tick_size, cast(min_notional as double) / 100 AS min_notional, 0.01::DOUBLE AS contract_size, is_trading FROM instruments""")
def instrument_rows(v):
    rows = v("instruments").withColumns({"step_size": F.lit(1).cast("long"), "min_qty": F.lit(1).cast("long"), "contract_size": F.lit(1).cast("long")})
    return landing.instrument_rows(rows).select("symbol", "base_asset", "quote_asset", *[F.col(c).cast("double").alias(c) for c in ("tick_size", "min_notional", "contract_size")], "is_trading")


@query("a16_route_by_type", """
    SELECT CASE event_type WHEN 'view' THEN 'best_bid_offers' WHEN 'signup' THEN 'mark_prices' WHEN 'error' THEN 'liquidations' WHEN 'purchase' THEN 'trades' END AS "table", count(*) AS n FROM ticks WHERE event_type <> 'click' GROUP BY 1""")
def route_by_type(v):
    code = F.element_at(F.create_map(*[F.lit(x) for k, c in (("view", 5), ("signup", 7), ("error", 9), ("purchase", 6), ("click", 13)) for x in (k, c)]), F.col("event_type"))
    return v("ticks").select(codes.name_of(code, landing.TABLES).alias("table")).where(F.col("table").isNotNull()).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def _frames(ticks, kind: str, data, kinds: str = "view"):
    body = F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit(f"@{kind}")).alias("stream"), data.alias("data")))
    return ticks.where(F.col("event_type") == kinds).select("event_id", body.alias("payload"))


def _text(c):
    return F.concat(((c - c % 100) / 100).cast("long").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


@query("b01_spot_frames", """SELECT event_id, event_id AS update_id, symbol, price AS bid, k + 1 AS bid_qty, price + 7 AS ask, k + 2 AS ask_qty FROM ticks WHERE event_type = 'view'""")
def spot_frames(v):
    data = F.struct(F.col("event_id").alias("u"), F.col("symbol").alias("s"), _text(F.col("price")).alias("b"), (F.col("k") + 1).cast("string").alias("B"), _text(F.col("price") + 7).alias("a"), (F.col("k") + 2).cast("string").alias("A"))
    q = J.parse(_frames(v("ticks"), "bookTicker", data), "bookTicker")
    return q.select("event_id", "update_id", "symbol", *[S.parse_scaled(F.col(f"{s}_price"), 2).alias(s) for s in ("bid", "ask")], *[S.parse_scaled(F.col(f"{s}_qty"), 0).alias(f"{s}_qty") for s in ("bid", "ask")])


@query("b01_spot_depth_frames", """SELECT event_id, symbol, k AS first_id, k + 3 AS final_id, [price, price + 1] AS bid_prices, ts_ns // 1000000 * 1000000 AS event_ns FROM ticks WHERE event_type = 'view'""")
def spot_depth_frames(v):
    pair = lambda d: F.array(_text(F.col("price") + d), F.col("k").cast("string"))
    data = F.struct(S.div(F.col("ts_ns"), F.lit(1_000_000)).alias("E"), F.col("symbol").alias("s"), F.col("k").alias("U"), (F.col("k") + 3).alias("u"), F.array(pair(0), pair(1)).alias("b"), F.array(pair(2)).alias("a"))
    d = J.parse(_frames(v("ticks"), "depth@100ms", data), "depth")
    return d.select("event_id", "symbol", "first_id", "final_id", F.transform(S.levels(F.col("bids"), 2, 0), lambda x: x["price"]).alias("bid_prices"), S.ms_to_ns(F.col("event_ms")).alias("event_ns"))


@query("b02_futures_frames", """SELECT event_id, symbol, CASE side_text WHEN 'BUY' THEN 0 WHEN 'SELL' THEN 1 END AS side, price, qty FROM liquidations""")
def futures_frames(v):
    order = F.struct(F.col("symbol").alias("s"), F.col("side_text").alias("S"), F.col("qty").cast("string").alias("q"), _text(F.col("price")).alias("p"))
    rows = v("liquidations").withColumn("event_type", F.lit("error"))
    f = J.parse(_frames(rows, "forceOrder", F.struct(F.lit(1).alias("E"), order.alias("o")), "error"), "forceOrder", J.FUTURES)
    return f.select("event_id", "symbol", codes.code_of(F.col("side"), codes.ORDER_SIDES).alias("side"), S.parse_scaled(F.col("price"), 2).alias("price"), S.parse_scaled(F.col("qty"), 0).alias("qty"))


@query("b11_user_events", """
    SELECT order_id, format('cc-{:04x}-{:016x}', instance, counter) AS cloid, CASE WHEN status = 'F' THEN 'TRADE' ELSE 'NEW' END AS execution_type, value AS last_fill_price, CASE WHEN status = 'F' THEN order_id END AS trade_id FROM requests""")
def user_events(v):
    r = v("requests")
    body = F.struct(F.lit("executionReport").alias("e"), F.lit(1).alias("E"), S.order_id(F.col("instance"), F.col("counter")).alias("c"), F.when(F.col("status") == "F", "TRADE").otherwise("NEW").alias("x"), _text(F.col("value")).alias("L"), F.when(F.col("status") == "F", F.col("order_id")).otherwise(F.lit(-1)).alias("t"))
    f = J.parse_user(r.select("order_id", F.to_json(body).alias("payload")), "executionReport")
    return f.select("order_id", "cloid", codes.known_or(F.col("execution_type"), codes.EXECUTION_TYPES).alias("execution_type"), S.parse_scaled(F.col("last_fill_price"), 2).alias("last_fill_price"), codes.trade_id(F.col("trade_id")).alias("trade_id"))


@query("d07_undecodable_frames", """SELECT event_id FROM ticks WHERE k % 3 = 0 OR k % 3 = 1""")
def undecodable_frames(v):
    broken = F.when(F.col("k") % 3 == 0, F.lit("{oops")).when(F.col("k") % 3 == 1, F.lit('{"stream":"x@kline","data":{}}')).otherwise(F.lit('{"stream":"x@trade","data":{}}'))
    return J.undecodable(v("ticks").select("event_id", broken.alias("payload"))).select("event_id")


@query("b12_exchange_info", """
    SELECT symbol, 'USDT' AS quote_asset, 2 AS price_scale, 5 AS qty_scale, 1000000::BIGINT AS tick_size, 1000::BIGINT AS step_size, CASE WHEN p_partkey % 2 = 0 THEN min_notional * 1000000 ELSE 0 END AS min_notional, is_trading FROM instruments""")
def exchange_info(v):
    rows = v("instruments")
    filters = F.array(
        F.create_map(F.lit("filterType"), F.lit("PRICE_FILTER"), F.lit("tickSize"), F.lit("0.01")),
        F.create_map(F.lit("filterType"), F.lit("LOT_SIZE"), F.lit("stepSize"), F.lit("0.00001"), F.lit("minQty"), F.lit("0.00001")),
        F.create_map(F.lit("filterType"), F.when(F.col("p_partkey") % 2 == 0, "MIN_NOTIONAL").otherwise("OTHER"), F.lit("minNotional"), _text(F.col("min_notional"))),
    )
    one = F.struct("symbol", F.when(F.col("is_trading"), "TRADING").otherwise("BREAK").alias("status"), F.lit("X").alias("baseAsset"), F.lit("USDT").alias("quoteAsset"), filters.alias("filters"))
    docs = rows.groupBy(F.floor(F.col("p_partkey") / 200).alias("g")).agg(F.collect_list(one).alias("symbols")).select(F.to_json(F.struct("symbols")).alias("payload"))
    return J.exchange_info(docs).select("symbol", "quote_asset", "price_scale", "qty_scale", "tick_size", "step_size", "min_notional", "is_trading")


@query("b14_depth_snapshots", """SELECT symbol, update_id, [bid_price] AS bid_prices, [ask_qty] AS ask_qtys FROM bbo""")
def depth_snapshots(v):
    b = v("bbo")
    body = F.struct(F.col("update_id").alias("lastUpdateId"), F.array(F.array(_text(F.col("bid_price")), F.col("bid_qty").cast("string"))).alias("bids"), F.array(F.array(_text(F.col("ask_price")), F.col("ask_qty").cast("string"))).alias("asks"))
    d = J.depth_snapshots(b.select("symbol", F.to_json(body).alias("payload")), 2, 0)
    return d.select("symbol", "update_id", F.transform("bids", lambda x: x["price"]).alias("bid_prices"), F.transform("asks", lambda x: x["qty"]).alias("ask_qtys"))
