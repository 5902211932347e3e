"""From exchange-native rows to normalised messages: scaled integers, nanoseconds, headers.

Inputs are rows of ``sources.json_frames`` or ``sources.binary`` joined with their instruments (symbol, price_scale, qty_scale). Events
of unknown kinds never get here, so they use up no sequence number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, scalars as S
from . import folds, numbering


def _scaled(*fields: str, scale: str) -> dict[str, Column]:
    return {f: S.parse_scaled(F.col(f), F.col(scale)) for f in fields}


def with_header(rows: DataFrame, message_type: int | None, connection: str, order: list[str], venue: int = 1, market: int = 1, instance: int = 0, range_: Column | None = None) -> DataFrame:
    """Rows with the message header: numbers run from 0 within a connection in the given order, one for each message. Without a
    message type the rows have their own.

    Where ``range_`` is given, a column that rises with the order such as the day, a connection is numbered range by range and never
    is one task's work.
    """
    number = (F.row_number().over(Window.partitionBy(connection).orderBy(*order)) - 1).cast("long")
    if range_ is not None:
        rows, number = numbering.numbered(rows, [connection], order, range_), F.col("number")
    return rows.withColumns({
        "schema_version": F.lit(1), "message_type": F.col("message_type") if message_type is None else F.lit(message_type), "venue_id": F.lit(venue), "market_type": F.lit(market), "instrument_id": S.instrument_id(F.col("symbol")),
        "connection_id": F.col(connection), "instance_id": F.lit(instance), "sequence_number": number, "exchange_tx_ts": F.lit(0).cast("long"),
    }).drop("number")


def quotes(rows: DataFrame) -> DataFrame:
    """bookTicker rows as BestBidOffer; the stream has no event time."""
    return rows.withColumns(_scaled("bid_price", "ask_price", scale="price_scale") | _scaled("bid_qty", "ask_qty", scale="qty_scale") | {"exchange_event_ts": F.lit(0).cast("long")})


def depth(rows: DataFrame) -> DataFrame:
    """depth rows as BookDelta; spot has no id of the update before."""
    before = F.col("prev_id") if "prev_id" in rows.columns else F.lit(0).cast("long")
    sides = {s: S.levels(F.col(s), F.col("price_scale"), F.col("qty_scale")) for s in ("bids", "asks")}
    return rows.withColumns(sides | {"prev_id": before, "exchange_event_ts": S.ms_to_ns(F.col("event_ms"))})


def trades(rows: DataFrame) -> DataFrame:
    """trade and aggTrade rows as Trade."""
    times = {"exchange_event_ts": S.ms_to_ns(F.col("event_ms")), "trade_ts": S.ms_to_ns(F.col("trade_ms"))}
    return rows.withColumns(_scaled("price", scale="price_scale") | _scaled("qty", scale="qty_scale") | times | {"aggressor_side": S.aggressor_side(F.col("is_buyer_maker"))})


def mark_prices(rows: DataFrame) -> DataFrame:
    """markPrice rows as a MarkPrice each, and a FundingRate (of nine decimals) after it where the event has a rate; delivery contracts have
    an empty one. An empty index price is 0."""
    mark = F.struct(F.lit(7).alias("message_type"), S.parse_scaled(F.col("mark_price"), F.col("price_scale")).alias("mark_price"),
                    F.when(F.coalesce("index_price", F.lit("")) == "", F.lit(0)).otherwise(S.parse_scaled(F.col("index_price"), F.col("price_scale"))).cast("long").alias("index_price"),
                    F.lit(None).cast("long").alias("funding_rate"), F.lit(None).cast("long").alias("next_funding_time"))
    rate = F.struct(F.lit(8).alias("message_type"), F.lit(None).cast("long").alias("mark_price"), F.lit(None).cast("long").alias("index_price"), S.parse_scaled(F.col("funding_rate"), 9).alias("funding_rate"), S.ms_to_ns(F.col("next_funding_ms")).alias("next_funding_time"))
    sent = F.when(F.coalesce("funding_rate", F.lit("")) == "", F.array(mark)).otherwise(F.array(mark, rate))
    rest = [c for c in rows.columns if c not in ("mark_price", "index_price", "funding_rate", "next_funding_ms")]
    return rows.select(*rest, S.ms_to_ns(F.col("event_ms")).alias("exchange_event_ts"), F.explode(sent).alias("_m")).select(*rest, "exchange_event_ts", "_m.*")


def liquidations(rows: DataFrame) -> DataFrame:
    """forceOrder rows as Liquidation; a side that is neither BUY nor SELL leaves the row out."""
    out = rows.withColumns(_scaled("price", "avg_price", scale="price_scale") | _scaled("qty", "last_filled_qty", scale="qty_scale") | {"side": codes.code_of(F.col("side"), codes.ORDER_SIDES)})
    return out.where(F.col("side").isNotNull())


def open_interest(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_scaled("open_interest", scale="qty_scale") | {"exchange_event_ts": S.ms_to_ns(F.col("event_ms"))})


def from_binary(rows: DataFrame, prices: tuple[str, ...] = (), qtys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the binary feed: mantissas of eight decimals to the instrument's scales, microseconds to nanoseconds."""

    def down(field: str, scale: str) -> Column:
        return S.div(F.col(field), S.pow10(F.lit(8) - F.col(scale)))

    out = {f: down(f, "price_scale") for f in prices} | {f: down(f, "qty_scale") for f in qtys} | {"exchange_event_ts": S.us_to_ns(F.col("event_us"))}
    if "aggressor_side" in rows.columns:
        out["aggressor_side"] = codes.from_binary_side(F.col("aggressor_side"))
    return rows.withColumns(out)


def order_updates(rows: DataFrame) -> DataFrame:
    """executionReport rows as order updates. The client id is null where it is not of this gateway's form; rows with an unknown side,
    type or time in force are left out."""
    out = rows.withColumns(
        _scaled("last_fill_price", scale="price_scale")
        | _scaled("last_fill_qty", "cum_fill_qty", scale="qty_scale")
        | {
            "own_cloid": F.when(S.order_counter(F.col("cloid")).isNotNull(), F.col("cloid")),
            "side": codes.code_of(F.col("side"), codes.ORDER_SIDES),
            "order_type": codes.code_of(F.col("order_type"), codes.ORDER_TYPES),
            "time_in_force": codes.code_of(F.col("time_in_force"), codes.TIMES_IN_FORCE),
            "execution_type": codes.known_or(F.col("execution_type"), codes.EXECUTION_TYPES),
            "reject_reason": codes.reject_reason(F.col("reject_reason")),
            "trade_id": codes.trade_id(F.col("trade_id")),
            "event_ns": S.ms_to_ns(F.col("event_ms")),
        }
    )
    return out.where(F.col("side").isNotNull() & F.col("order_type").isNotNull() & F.col("time_in_force").isNotNull())


def recovery_outcomes(updates: DataFrame, fold: folds.Fold = folds.SPOT_SEQUENCE, tasks: int | None = None) -> DataFrame:
    """For each snapshot of a symbol, how many of the deltas up to the next one were replayed and discarded, and whether a gap ended it."""
    judged = folds.run(updates, fold, "symbol", ["n"], tasks=tasks)
    episode = F.max(F.when(F.col("kind") == "snapshot", F.col("final_id"))).over(Window.partitionBy("symbol").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    placed = judged.withColumn("snapshot_id", episode).where(F.col("snapshot_id").isNotNull())
    return placed.groupBy("symbol", "snapshot_id").agg(F.count_if(F.col("result") == "Apply").alias("replayed"), F.count_if(F.col("result") == "Discard").alias("discarded"), (F.count_if(F.col("result") == "Gap") > 0).alias("failed"))


def staleness(updates: DataFrame, fold: folds.Fold = folds.SPOT_SEQUENCE, tasks: int | None = None) -> DataFrame:
    """Whether each symbol's book is stale after each update: from a gap until the next snapshot. Levels are not touched by it."""
    judged = folds.run(updates, fold, "symbol", ["n"], tasks=tasks)
    last = F.last(F.when(F.col("result").isin("Gap", "Snapshot"), F.col("result")), ignorenulls=True)
    return judged.select("symbol", "n", "result", F.coalesce(last.over(Window.partitionBy("symbol").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) == "Gap", F.lit(False)).alias("is_stale"))


def dead_sessions(events: DataFrame) -> DataFrame:
    """Pings that got no answer before the connection's next ping: the session is dead then."""
    by = Window.partitionBy("symbol").orderBy("ts_ns", "event_id")
    following = F.lead("kind").over(by)
    return events.where(F.col("kind").isin("ping", "pong")).withColumn("_next", following).where((F.col("kind") == "ping") & (F.col("_next") == "ping")).drop("_next")
