"""Code vocabularies of messages and orders, and their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers as they stand in messages
MESSAGE_TYPES = {
    1: "InstrumentDefinition", 2: "TradingStatus", 3: "BookSnapshot", 4: "BookDelta", 5: "BestBidOffer", 6: "Trade", 7: "MarkPrice", 8: "FundingRate",
    9: "Liquidation", 10: "OpenInterest", 11: "AccountUpdate", 12: "OrderUpdate", 13: "Heartbeat", 14: "FeedStatus", 15: "GapDetected", 16: "BookStale",
    17: "BookRecovered", 18: "BookChecksum",
}
FEED_STATES = {1: "Connecting", 2: "Live", 3: "Degraded", 4: "Stale", 5: "Recovering", 6: "Recovered", 7: "Failed"}
AGGRESSORS = {0: "Unknown", 1: "Buy", 2: "Sell"}
BINARY_AGGRESSORS = {0: "Sell", 1: "Buy"}
ORDER_SIDES, ORDER_TYPES, TIMES_IN_FORCE = {"BUY": 0, "SELL": 1}, {"LIMIT": 0, "MARKET": 1}, {"GTC": 0, "IOC": 1, "FOK": 2}
REST_STATUSES = ("NEW", "PARTIALLY_FILLED", "FILLED", "CANCELED", "PENDING_CANCEL", "REJECTED", "EXPIRED", "EXPIRED_IN_MATCH")
LIVE_STATUSES = ("NEW", "PARTIALLY_FILLED", "PENDING_CANCEL")
EXECUTION_TYPES = ("NEW", "CANCELED", "REPLACED", "REJECTED", "TRADE", "EXPIRED", "TRADE_PREVENTION")
TERMINAL = ("Filled", "Cancelled", "Rejected", "Expired")


def name_of(code: Column, names: dict[int, str]) -> Column:
    """The name of a code; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), code.cast("int"))


def code_of(name: Column, codes: dict[str, int]) -> Column:
    """The code of a name; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)]), name)


def known_or(name: Column, names: tuple[str, ...], other: str = "Unknown") -> Column:
    return F.when(name.isin(*names), name).otherwise(other)


def from_binary_side(code: Column) -> Column:
    """The message code of a binary feed's aggressor: there 0 sells and 1 buys, here 2 sells and 0 is unknown."""
    return F.when(code == 0, 2).when(code == 1, 1).otherwise(0)


def reject_reason(raw: Column) -> Column:
    """Null where there is none: empty or ``NONE``."""
    return F.nullif(F.nullif(raw, F.lit("")), F.lit("NONE"))


def trade_id(raw: Column) -> Column:
    """Null where there is none: negative."""
    return F.when(raw >= 0, raw)
