"""Rows of the landing tables, routing by message type, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Message type -> table
TABLES = {6: "trades", 5: "best_bid_offers", 7: "mark_prices", 8: "funding_rates", 9: "liquidations", 10: "open_interest", 4: "book_deltas", 1: "instruments"}
#: Sort key of every table but instruments
SORT = ("symbol", "exchange_event_ts")


def route(messages: DataFrame, shard: str, shards: int, shadow: bool = False) -> DataFrame:
    """Messages with ``stream_id``, the stream of their shard, and ``error``: shards outside 0 to ``shards`` - 1 and null ones have no
    stream and are an error each, so a sink can set them aside."""
    known = F.col(shard).between(0, shards - 1)
    stream = F.col(shard).cast("long") + 1 + (S.SHADOW_STREAMS if shadow else 0)
    named = F.concat(F.lit("unknown shard "), F.coalesce(F.col(shard).cast("string"), F.lit("null")))
    return messages.withColumns({"stream_id": F.when(known, stream), "error": F.when(F.coalesce(known, F.lit(False)), None).otherwise(named)})


def _decimals(df: DataFrame, prices: tuple[str, ...], scale: str, to: int = 8) -> dict:
    return {c: S.as_decimal(F.col(c), F.col(scale), to) for c in prices}


def trade_rows(trades: DataFrame) -> DataFrame:
    return trades.withColumns(_decimals(trades, ("price",), "price_scale") | _decimals(trades, ("qty",), "qty_scale") | {"aggressor_side": S.aggressor_side(F.col("is_buyer_maker"))}).drop("price_scale", "qty_scale")


def bbo_rows(bbo: DataFrame) -> DataFrame:
    return bbo.withColumns(_decimals(bbo, ("bid_price", "ask_price"), "price_scale") | _decimals(bbo, ("bid_qty", "ask_qty"), "qty_scale")).drop("price_scale", "qty_scale")


def mark_rows(marks: DataFrame) -> DataFrame:
    return marks.withColumns(_decimals(marks, ("mark_price", "index_price"), "price_scale")).drop("price_scale")


def funding_rows(rates: DataFrame) -> DataFrame:
    return rates.withColumns(_decimals(rates, ("funding_rate",), "funding_rate_scale", 9)).drop("funding_rate_scale")


def liquidation_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_decimals(rows, ("price", "avg_price"), "price_scale") | _decimals(rows, ("qty", "last_filled_qty"), "qty_scale")).drop("price_scale", "qty_scale")


def open_interest_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_decimals(rows, ("open_interest",), "qty_scale")).drop("qty_scale")


def delta_rows(deltas: DataFrame) -> DataFrame:
    """Levels as four parallel arrays of decimals."""

    def side(name: str, field: str, scale: str):
        return F.transform(name, lambda x: S.as_decimal(x[field], F.col(scale)))

    out = {f"{s[:-1]}_{'prices' if f == 'price' else 'qtys'}": side(s, f, f"{f}_scale") for s in ("bids", "asks") for f in ("price", "qty")}
    return deltas.withColumns(out).drop("bids", "asks", "price_scale", "qty_scale")


def instrument_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_decimals(rows, ("tick_size", "min_notional"), "price_scale") | _decimals(rows, ("step_size", "min_qty", "contract_size"), "qty_scale"))


def mark_and_funding(events: DataFrame) -> DataFrame:
    """Of each mark-price event a MarkPrice row, and a FundingRate row if its rate's text is not empty; an empty index price is 0."""
    mark = F.struct(F.lit(7).alias("message_type"), S.parse_scaled(F.col("mark_text"), 8).alias("value"), F.coalesce(S.parse_scaled(F.nullif("index_text", F.lit("")), 8), F.lit(0).cast("long")).alias("second"))
    rate = F.struct(F.lit(8).alias("message_type"), S.parse_scaled(F.col("rate_text"), 9).alias("value"), F.col("next_funding_ns").alias("second"))
    some = F.when(F.coalesce(F.trim("rate_text"), F.lit("")) != "", F.array(mark, rate)).otherwise(F.array(mark))
    return events.withColumn("_m", F.explode(some)).select("symbol", "ts_ns", "_m.*")


def write_by_type(messages: DataFrame, folder: str) -> dict[str, str]:
    """Append each message type's rows to its table under ``folder``, sorted by the table's key; the paths by table."""
    paths = {}
    for code, table in TABLES.items():
        paths[table] = f"{folder}/{table}"
        rows = messages.where(F.col("message_type") == code)
        rows.repartition("symbol").sortWithinPartitions(*SORT).write.mode("append").parquet(paths[table])
    return paths


def write_shards(messages: DataFrame, folder: str, shards: int) -> None:
    """Append messages to one folder per shard, all of a shard's keys in order within a file."""
    known = messages.where((F.col("shard_id") >= 0) & (F.col("shard_id") < shards))
    known.repartition("shard_id", "symbol").sortWithinPartitions("shard_id", *SORT).write.mode("append").partitionBy("shard_id").parquet(folder)
