"""Exchange frames in JSON as typed rows. Keys that differ only by case are told apart by paths, so no session setting is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import derive_scale, instrument_id, levels, parse_scaled

# Fields of each stream kind as (column, path below `data`, type); "pairs" are [[price, qty], ...]
_QUOTE = [("update_id", "u", "long"), ("symbol", "s", "string"), ("bid_price", "b", "string"), ("bid_qty", "B", "string"), ("ask_price", "a", "string"), ("ask_qty", "A", "string")]
_DEPTH = [("event_ms", "E", "long"), ("symbol", "s", "string"), ("first_id", "U", "long"), ("final_id", "u", "long"), ("bids", "b", "pairs"), ("asks", "a", "pairs")]
_TRADE = [("event_ms", "E", "long"), ("symbol", "s", "string"), ("price", "p", "string"), ("qty", "q", "string"), ("trade_ms", "T", "long"), ("is_buyer_maker", "m", "boolean")]
SPOT = {"bookTicker": _QUOTE, "depth": _DEPTH, "trade": [*_TRADE, ("trade_id", "t", "long")]}
FUTURES = {
    "bookTicker": _QUOTE,
    "depth": [*_DEPTH, ("prev_id", "pu", "long"), ("transaction_ms", "T", "long")],
    "aggTrade": [*_TRADE, ("trade_id", "a", "long"), ("first_trade_id", "f", "long"), ("last_trade_id", "l", "long")],
    "markPrice": [("event_ms", "E", "long"), ("symbol", "s", "string"), ("mark_price", "p", "string"), ("index_price", "i", "string"), ("funding_rate", "r", "string"), ("next_funding_ms", "T", "long")],
    "forceOrder": [("event_ms", "E", "long"), ("symbol", "o.s", "string"), ("side", "o.S", "string"), ("qty", "o.q", "string"), ("price", "o.p", "string"), ("avg_price", "o.ap", "string"), ("last_filled_qty", "o.l", "string"), ("trade_ms", "o.T", "long")],
}
USER = {
    "executionReport": [
        ("event_ms", "E", "long"), ("symbol", "s", "string"), ("cloid", "c", "string"), ("side", "S", "string"), ("order_type", "o", "string"), ("time_in_force", "f", "string"), ("order_qty", "q", "string"), ("order_price", "p", "string"),
        ("execution_type", "x", "string"), ("order_status", "X", "string"), ("reject_reason", "r", "string"), ("exchange_id", "i", "long"), ("last_fill_qty", "l", "string"), ("cum_fill_qty", "z", "string"), ("last_fill_price", "L", "string"),
        ("transaction_ms", "T", "long"), ("trade_id", "t", "long"), ("commission", "n", "string"), ("commission_asset", "N", "string"), ("is_maker", "m", "boolean"),
    ],
    "outboundAccountPosition": [("event_ms", "E", "long"), ("last_update_ms", "u", "long"), ("balances", "B", "array<struct<a:string,f:string,l:string>>")],
    "balanceUpdate": [("event_ms", "E", "long"), ("asset", "a", "string"), ("delta", "d", "string"), ("clear_ms", "T", "long")],
}


def _field(payload: Column, path: str, kind: str) -> Column:
    text = F.get_json_object(payload, path)
    if kind == "string":
        return text
    if kind == "pairs":
        return F.from_json(text, "array<array<string>>")
    return text.try_cast(kind) if kind in ("long", "boolean") else F.from_json(text, kind)


def stream_kind(payload: Column) -> Column:
    """What follows the first ``@`` of the stream's name, without a speed such as ``@100ms``."""
    return F.element_at(F.split(F.get_json_object(payload, "$.stream"), "@"), 2)


def parse(frames: DataFrame, kind: str, fields: dict = SPOT, root: str = "$.data.") -> DataFrame:
    """Rows of one stream kind, the frame's other columns kept. Frames that cannot be read have a null symbol: see ``undecodable``."""
    some = frames.where(stream_kind(F.col("payload")) == kind)
    return some.select(*[c for c in frames.columns if c != "payload"], *[_field(F.col("payload"), root + path, t).alias(name) for name, path, t in fields[kind]])


def parse_user(frames: DataFrame, event: str) -> DataFrame:
    """Rows of one kind of user-data event, told by ``e``."""
    some = frames.where(F.get_json_object("payload", "$.e") == event)
    return some.select(*[c for c in frames.columns if c != "payload"], *[_field(F.col("payload"), "$." + path, t).alias(name) for name, path, t in USER[event]])


def undecodable(frames: DataFrame, fields: dict = SPOT) -> DataFrame:
    """Frames whose kind is not one of ``fields``, or that are no JSON."""
    kind = stream_kind(F.col("payload"))
    return frames.where(kind.isNull() | ~kind.isin(*fields))


def exchange_info(documents: DataFrame) -> DataFrame:
    """Instrument definitions from exchange-info documents (column ``payload``), numbered in order.

    Tick and step come from their filters, the least notional from NOTIONAL or MIN_NOTIONAL, whichever stands first; scales are the
    decimals of tick and step as written; values are kept at eight decimals.
    """
    kind = "array<struct<symbol:string,status:string,baseAsset:string,quoteAsset:string,filters:array<map<string,string>>>>"
    rows = documents.select(F.posexplode(F.from_json(F.get_json_object("payload", "$.symbols"), kind)).alias("sequence_number", "s")).select("sequence_number", "s.*")

    def first(*types: str) -> Column:
        return F.get(F.filter("filters", lambda f: f["filterType"].isin(*types)), F.lit(0))

    price, lot, notional = first("PRICE_FILTER"), first("LOT_SIZE"), first("NOTIONAL", "MIN_NOTIONAL")
    texts = rows.select(
        "sequence_number", "symbol", F.col("baseAsset").alias("base_asset"), F.col("quoteAsset").alias("quote_asset"), (F.col("status") == "TRADING").alias("is_trading"),
        F.coalesce(price["tickSize"], F.lit("1")).alias("tick"), F.coalesce(lot["stepSize"], F.lit("1")).alias("step"), F.coalesce(lot["minQty"], F.lit("0")).alias("least"),
        F.coalesce(notional["minNotional"], notional["notional"], F.lit("0")).alias("notional"),
    )
    return texts.select(
        "sequence_number", "symbol", instrument_id(F.col("symbol")).alias("instrument_id"), "base_asset", "quote_asset", derive_scale(F.col("tick")).alias("price_scale"), derive_scale(F.col("step")).alias("qty_scale"),
        parse_scaled(F.col("tick"), 8).alias("tick_size"), parse_scaled(F.col("step"), 8).alias("step_size"), parse_scaled(F.col("least"), 8).alias("min_qty"), parse_scaled(F.col("notional"), 8).alias("min_notional"), "is_trading",
    )


def depth_snapshots(documents: DataFrame, price_scale: int, qty_scale: int) -> DataFrame:
    """(symbol, update_id, bids, asks) from depth-snapshot documents with their symbol."""
    pairs = "array<array<string>>"
    return documents.select(
        "symbol",
        F.get_json_object("payload", "$.lastUpdateId").cast("long").alias("update_id"),
        *[levels(F.from_json(F.get_json_object("payload", f"$.{side}"), pairs), price_scale, qty_scale).alias(side) for side in ("bids", "asks")],
    )
