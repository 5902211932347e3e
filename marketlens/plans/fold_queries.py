"""Queries of ordered folds. Their SQL twins walk each key's rows one by one in a recursive table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, islands
from .catalog import query


def _walk(rows: str, start: str, step: str, show: str, last: bool = False) -> str:
    """A fold in SQL: ``rows`` has symbol and rn from 1; ``start`` and ``step`` list the state's columns, the latter over f and r.
    ``last`` shows only the last row of each symbol."""
    only = " QUALIFY f.rn = max(f.rn) OVER (PARTITION BY f.symbol)" if last else ""
    return f"""WITH RECURSIVE r AS MATERIALIZED ({rows}),
      f AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, {start} FROM r UNION ALL SELECT r.symbol, r.rn, {step} FROM f JOIN r ON r.symbol = f.symbol AND r.rn = f.rn + 1)
      SELECT {show} FROM f JOIN r ON r.symbol = f.symbol AND r.rn = f.rn WHERE f.rn > 0{only}"""


def _sequence_sql(found: str, wanted_last: str, gap_bridge: tuple[str, str]) -> str:
    gap = f"f.mode = 'active' AND {found} > f.last + {wanted_last}"
    result = f"""CASE WHEN r.kind = 'snapshot' THEN 'Snapshot' WHEN f.mode IN ('awaiting', 'stale') THEN 'Buffering'
      WHEN f.mode = 'bridging' THEN CASE WHEN r.final_id <= f.last THEN 'Discard' WHEN r.first_id <= f.last + 1 THEN 'Apply' ELSE 'Gap' END
      WHEN {found} = f.last + {wanted_last} THEN 'Apply' WHEN {found} < f.last + {wanted_last} THEN 'Discard' ELSE 'Gap' END"""
    bridge_gap = "f.mode = 'bridging' AND r.final_id > f.last AND r.first_id > f.last + 1"
    applied = f"(f.mode = 'bridging' AND r.final_id > f.last AND r.first_id <= f.last + 1 OR f.mode = 'active' AND {found} = f.last + {wanted_last})"
    step = f"""CASE WHEN r.kind = 'snapshot' THEN 'bridging' WHEN {applied} THEN 'active' WHEN {bridge_gap} OR {gap} THEN 'stale' ELSE f.mode END,
      CASE WHEN r.kind = 'snapshot' OR {applied} THEN r.final_id ELSE f.last END, {result},
      CASE WHEN r.kind <> 'snapshot' AND {bridge_gap} THEN {gap_bridge[0]} WHEN r.kind <> 'snapshot' AND {gap} THEN f.last + {wanted_last} END,
      CASE WHEN r.kind <> 'snapshot' AND {bridge_gap} THEN {gap_bridge[1]} WHEN r.kind <> 'snapshot' AND {gap} THEN {found} END"""
    return _walk("SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS rn FROM deltas", "'awaiting' AS mode, 0::BIGINT AS last, '' AS result, NULL::BIGINT AS expected, NULL::BIGINT AS actual", step, "r.symbol, r.n, r.first_id, r.final_id, f.result, f.expected, f.actual")


@query("g01_spot_sequence", _sequence_sql("r.first_id", "1", ("f.last + 1", "r.first_id")))
def spot_sequence(v):
    return folds.run(v("deltas"), folds.SPOT_SEQUENCE, "symbol", ["n"], [], v.tasks("events")).select("symbol", "n", "first_id", "final_id", "result", "expected", "actual")


@query("g02_futures_sequence", _sequence_sql("r.prev_id", "0", ("f.last", "r.prev_id")))
def futures_sequence(v):
    return folds.run(v("deltas"), folds.FUTURES_SEQUENCE, "symbol", ["n"], [], v.tasks("events")).select("symbol", "n", "first_id", "final_id", "result", "expected", "actual")


_TIMED = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS rn FROM"


@query("g11_bbo_timer", _walk(
    "SELECT symbol, event_id, ts_ns, k, price, CASE WHEN k < 5 THEN NULL ELSE price END AS book_bid, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS rn FROM ticks",
    "-1::BIGINT AS since, '' AS action, 0::BIGINT AS lasted",
    """CASE WHEN r.k < 30 OR r.ts_ns - (CASE WHEN f.since < 0 THEN r.ts_ns ELSE f.since END) >= 14400000000000 THEN -1 WHEN f.since < 0 THEN r.ts_ns ELSE f.since END,
       CASE WHEN r.k < 30 OR f.since < 0 THEN 'Ok' WHEN r.ts_ns - f.since >= 14400000000000 THEN 'MarkStale' WHEN r.ts_ns - f.since >= 3600000000000 THEN 'Degrade' ELSE 'Ok' END,
       CASE WHEN r.k < 30 OR f.since < 0 THEN 0 ELSE r.ts_ns - f.since END""",
    "r.symbol, r.event_id, f.action, f.lasted AS mismatch_ns"))
def bbo_timer(v):
    bid = F.when(F.col("k") < 30, F.col("price")).otherwise(F.col("price") + 1)
    rows = v("ticks").select("symbol", "event_id", "ts_ns", F.when(F.col("k") >= 5, F.col("price")).alias("book_bid"), F.col("price").alias("book_ask"), bid.alias("bid_price"), F.col("price").alias("ask_price"))
    hour = 3600 * folds.SECOND
    return islands.bbo_timer(rows, hour, 4 * hour).select("symbol", "event_id", "action", "mismatch_ns")


_COOL = "21600000000000"


@query("g08_circuit_breaker", _walk(
    f"{_TIMED} attempts", "0::BIGINT AS failures, -1::BIGINT AS until, '' AS state_before, false AS opened",
    f"""CASE WHEN r.ok THEN 0 WHEN f.until >= 0 AND r.ts_ns < f.until THEN f.failures ELSE CASE WHEN f.until >= 0 THEN 0 ELSE f.failures END + 1 END,
       CASE WHEN r.ok THEN -1 WHEN f.until >= 0 AND r.ts_ns < f.until THEN f.until WHEN CASE WHEN f.until >= 0 THEN 0 ELSE f.failures END + 1 >= 5 THEN r.ts_ns + {_COOL} ELSE -1 END,
       CASE WHEN f.until >= 0 AND r.ts_ns < f.until THEN 'Open' ELSE 'Closed' END,
       NOT r.ok AND NOT (f.until >= 0 AND r.ts_ns < f.until) AND CASE WHEN f.until >= 0 THEN 0 ELSE f.failures END + 1 >= 5""",
    "r.symbol, r.event_id, f.state_before, f.opened, f.failures"))
def circuit_breaker(v):
    return folds.run(v("attempts"), folds.circuit_breaker(5, int(_COOL)), "symbol", ["ts_ns", "event_id"], [], v.tasks("events")).select("symbol", "event_id", "state_before", "opened", "failures")


@query("g06_recovery_buffer", _walk(
    f"{_TIMED} ticks", "-1::BIGINT AS oldest, 0::BIGINT AS events, 0::BIGINT AS held, '' AS outcome",
    """CASE WHEN r.k = 0 OR f.events = 0 THEN r.ts_ns ELSE f.oldest END,
       CASE WHEN r.k = 0 THEN 1 WHEN f.events > 0 AND r.ts_ns - f.oldest > 360000000000000 OR f.events >= 12 OR f.held + r.price > 300000 THEN f.events ELSE f.events + 1 END,
       CASE WHEN r.k = 0 THEN r.price WHEN f.events > 0 AND r.ts_ns - f.oldest > 360000000000000 OR f.events >= 12 OR f.held + r.price > 300000 THEN f.held ELSE f.held + r.price END,
       CASE WHEN r.k = 0 THEN 'Accepted' WHEN f.events > 0 AND r.ts_ns - f.oldest > 360000000000000 THEN 'Age' WHEN f.events >= 12 THEN 'EventCount' WHEN f.held + r.price > 300000 THEN 'ByteSize' ELSE 'Accepted' END""",
    "r.symbol, r.event_id, f.outcome, f.events AS buffered"))
def recovery_buffer(v):
    rows = v("ticks").withColumn("drain", F.col("k") == 0).withColumn("size", F.col("price"))
    return folds.run(rows, folds.recovery_buffer(360_000 * folds.SECOND, 12, 300_000), "symbol", ["ts_ns", "event_id"], [], v.tasks("events")).select("symbol", "event_id", "outcome", "buffered")


@query("g22_backpressure", _walk(
    f"{_TIMED} offers", "-1::BIGINT AS since, '' AS outcome, 0::BIGINT AS elapsed",
    """CASE WHEN r.offer IN ('Ok', 'Closed') THEN -1 WHEN f.since < 0 THEN r.ts_ns ELSE f.since END,
       CASE WHEN r.offer = 'Ok' THEN 'Accepted' WHEN r.offer = 'Closed' THEN 'Closed' WHEN f.since < 0 THEN 'Retrying' WHEN r.ts_ns - f.since >= 100000000 THEN 'Restart' WHEN r.ts_ns - f.since >= 30000000 THEN 'Degrade' WHEN r.ts_ns - f.since >= 10000000 THEN 'Warned' ELSE 'Retrying' END,
       CASE WHEN r.offer IN ('Ok', 'Closed') OR f.since < 0 THEN 0 ELSE r.ts_ns - f.since END""",
    "r.symbol, r.event_id, f.outcome, f.elapsed AS elapsed_ns"))
def backpressure(v):
    return islands.backpressure(v("offers"), 10_000_000, 30_000_000, 100_000_000).select("symbol", "event_id", "outcome", "elapsed_ns")


_HELD = "len(f.ids) > 0 AND r.update_id < f.ids[1]"
_PLACE = "coalesce(list_position(f.ids, r.update_id), 0)"


def _side(name: str, own: str) -> str:
    """The checksums of one side after a row: put at its version's place, or behind, the oldest of more than 64 out first."""
    value = f"CASE WHEN {own} THEN r.checksum END"
    put = f"list_concat(f.{name}[:{_PLACE} - 1], [r.checksum], f.{name}[{_PLACE} + 1:])"
    behind = f"list_append(f.{name}, {value})"
    return f"CASE WHEN {_HELD} THEN f.{name} WHEN {_PLACE} > 0 THEN CASE WHEN {own} THEN {put} ELSE f.{name} END WHEN len(f.ids) >= 64 THEN ({behind})[2:] ELSE {behind} END"


@query("g15_checksum_arbiter", f"""
    WITH states AS ({_walk(
        "SELECT *, ord AS rn FROM feed_checksums", "[]::BIGINT[] AS ids, []::VARCHAR[] AS actives, []::VARCHAR[] AS passives, false AS stale",
        f"CASE WHEN {_HELD} OR {_PLACE} > 0 THEN f.ids WHEN len(f.ids) >= 64 THEN list_append(f.ids, r.update_id)[2:] ELSE list_append(f.ids, r.update_id) END, {_side('actives', 'r.instance_id = 0')}, {_side('passives', 'r.instance_id <> 0')}, {_HELD}",
        "r.symbol, r.ord, r.update_id, f.stale, f.actives[list_position(f.ids, r.update_id)] AS a, f.passives[list_position(f.ids, r.update_id)] AS p")})
    SELECT symbol, ord, update_id, CASE WHEN stale THEN 'Stale' WHEN a IS NULL OR p IS NULL THEN 'Pending' WHEN a = p THEN 'Matched' ELSE 'Diverged' END AS verdict FROM states""")
def checksum_arbiter(v):
    return folds.run(v("feed_checksums"), folds.checksum_arbiter(), "symbol", ["ord"], [], v.tasks("events")).select("symbol", "ord", "update_id", "verdict")


_SCHEDULE = "CASE WHEN k < 5 THEN 'startup' WHEN k < 10 THEN 'reconnect' WHEN k < 20 THEN 'startup_done' WHEN k < 30 THEN 'reconnect_done' WHEN k < 60 THEN 'periodic_done' ELSE 'tick' END"


@query("g20_reconcile_schedule", _walk(
    f"SELECT symbol, event_id, ts_ns, {_SCHEDULE} AS event, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns, event_id) AS rn FROM ticks",
    "false AS startup, false AS reconnect, -1::BIGINT AS next_due",
    """CASE r.event WHEN 'startup' THEN true WHEN 'startup_done' THEN false ELSE f.startup END, CASE r.event WHEN 'reconnect' THEN true WHEN 'reconnect_done' THEN false ELSE f.reconnect END,
       CASE WHEN r.event IN ('startup', 'periodic_done') OR r.event = 'reconnect' AND f.next_due < 0 THEN r.ts_ns + 21600000000000 ELSE f.next_due END""",
    "r.symbol, r.event_id, concat_ws(',', CASE WHEN f.startup THEN 'Startup' END, CASE WHEN f.reconnect THEN 'Reconnect' END, CASE WHEN f.next_due >= 0 AND f.next_due <= r.ts_ns THEN 'Periodic' END) AS due"))
def reconcile_schedule(v):
    rows = v("ticks").withColumn("event", F.expr(_SCHEDULE))
    return folds.run(rows, folds.reconcile_schedule(21_600 * folds.SECOND), "symbol", ["ts_ns", "event_id"], [], v.tasks("events")).select("symbol", "event_id", "due")


_EVENTS = """
    SELECT order_id AS symbol, 0 AS phase, 0 AS ord, 'submit' AS event, 0 AS trade_id, 0 AS qty FROM requests
    UNION ALL SELECT order_id, CASE WHEN order_id % 4 = 0 THEN 2 ELSE 1 END, 0, 'ack', 0, 0 FROM requests WHERE order_id % 11 <> 0
    UNION ALL SELECT order_id, 1, 10 + ord, 'fill', trade_id, qty FROM fills
    UNION ALL SELECT order_id, 3, 0, CASE order_id % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'expire' ELSE 'reject' END, 0, 0 FROM requests WHERE order_id % 5 = 0"""
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY phase, ord) AS rn FROM ({_EVENTS}) AS e"


def _order_tasks(v):
    return v.tasks("orders", "lineitem", times=2)  # an order has up to five events beside its fills


def _row_number(by):
    return F.row_number().over(by).cast("long")


def _order_events(v):
    r, f = v("requests"), v("fills")
    zero = F.lit(0).cast("long")

    def rows(df, phase, ord_, event, trade=zero, qty=zero):
        return df.select(F.col("order_id").alias("symbol"), phase.cast("long").alias("phase"), ord_.cast("long").alias("ord"), event.alias("event"), trade.alias("trade_id"), qty.alias("qty"))

    last = F.when(F.col("order_id") % 3 == 0, "cancel").when(F.col("order_id") % 3 == 1, "expire").otherwise("reject")
    parts = (
        rows(r, F.lit(0), F.lit(0), F.lit("submit")),
        rows(r.where("order_id % 11 <> 0"), F.when(F.col("order_id") % 4 == 0, 2).otherwise(1), F.lit(0), F.lit("ack")),
        rows(f, F.lit(1), F.col("ord") + 10, F.lit("fill"), F.col("trade_id"), F.col("qty")),
        rows(r.where("order_id % 5 = 0"), F.lit(3), F.lit(0), last),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ts_ns", F.col("phase") * folds.SECOND).withColumn("total_qty", F.lit(10_000).cast("long"))


@query("g17_order_machine", _walk(
    f"SELECT s.*, s.event = 'fill' AND s.rn > min(s.rn) OVER (PARTITION BY s.symbol, s.event, s.trade_id) AS again FROM ({_NUMBERED}) AS s",
    "'None' AS status, 0::BIGINT AS filled, 0::BIGINT AS waiting, '' AS action",
    """CASE WHEN r.event = 'submit' THEN 'Pending' WHEN f.status IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN f.status
         WHEN r.event = 'fill' AND (r.again OR f.status = 'Pending') THEN f.status WHEN r.event = 'fill' THEN CASE WHEN f.filled + r.qty >= 10000 THEN 'Filled' ELSE 'PartiallyFilled' END
         WHEN r.event = 'ack' AND f.status = 'Pending' THEN CASE WHEN f.filled + f.waiting >= 10000 THEN 'Filled' WHEN f.filled + f.waiting > 0 THEN 'PartiallyFilled' ELSE 'New' END
         WHEN r.event = 'cancel' THEN 'Cancelled' WHEN r.event = 'reject' THEN 'Rejected' WHEN r.event = 'expire' AND f.status <> 'Pending' THEN 'Expired' ELSE f.status END,
       CASE WHEN f.status IN ('New', 'PartiallyFilled') AND r.event = 'fill' AND NOT r.again THEN f.filled + r.qty WHEN f.status = 'Pending' AND r.event = 'ack' THEN f.filled + f.waiting ELSE f.filled END,
       CASE WHEN f.status = 'Pending' AND r.event = 'fill' AND NOT r.again THEN f.waiting + r.qty WHEN f.status = 'Pending' AND r.event = 'ack' THEN 0 ELSE f.waiting END,
       CASE WHEN r.event = 'submit' THEN 'Submitted' WHEN f.status IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') OR r.again THEN 'Ignored' WHEN r.event = 'fill' THEN CASE WHEN f.status = 'Pending' THEN 'Buffered' ELSE 'ApplyFill' END
         WHEN r.event = 'ack' AND f.status = 'Pending' THEN 'ApplyAck' WHEN r.event = 'cancel' THEN 'ApplyCancel' WHEN r.event = 'reject' THEN 'ApplyReject' WHEN r.event = 'expire' AND f.status <> 'Pending' THEN 'ApplyExpire' ELSE 'Ignored' END""",
    "r.symbol AS order_id, r.rn, r.event, f.status, f.filled AS filled_qty, f.waiting AS lost_or_waiting_qty, f.action"))
def order_machine(v):
    done = folds.run(_order_events(v), folds.order_machine(), "symbol", ["phase", "ord"], [], _order_tasks(v), {"rn": _row_number})
    return done.select(F.col("symbol").alias("order_id"), "rn", "event", "status", "filled_qty", "lost_or_waiting_qty", "action")


@query("g19_gateway", _walk(
    _NUMBERED, "'None' AS status, 0::BIGINT AS filled, false AS invalid",
    """CASE WHEN r.event = 'submit' THEN 'Pending' WHEN f.status IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN f.status WHEN r.event = 'fill' THEN CASE WHEN f.filled + r.qty >= 10000 THEN 'Filled' ELSE 'PartiallyFilled' END
         ELSE CASE r.event WHEN 'ack' THEN 'New' WHEN 'cancel' THEN 'Cancelled' WHEN 'reject' THEN 'Rejected' ELSE 'Expired' END END,
       CASE WHEN r.event = 'submit' THEN 0 WHEN r.event = 'fill' AND f.status NOT IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN f.filled + r.qty ELSE f.filled END,
       r.event <> 'submit' AND f.status IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') AND NOT (r.event = 'cancel' AND f.status = 'Cancelled')""",
    "r.symbol AS order_id, r.rn, f.status, f.filled AS filled_qty, f.invalid"))
def gateway(v):
    done = folds.run(_order_events(v), folds.gateway(), "symbol", ["phase", "ord"], [], _order_tasks(v), {"rn": _row_number})
    return done.select(F.col("symbol").alias("order_id"), "rn", "status", "filled_qty", "invalid")


_UNKNOWN = """
    SELECT order_id AS symbol, 0 AS moment, 0 AS ord, 'submit' AS event, 0 AS trade_id, 0 AS qty FROM requests
    UNION ALL SELECT order_id, 1, 0, 'ack', 0, 0 FROM requests WHERE order_id % 3 = 0
    UNION ALL SELECT order_id, 4, 0, 'tick', 0, 0 FROM requests
    UNION ALL SELECT order_id, 6, 0, 'tick', 0, 0 FROM requests
    UNION ALL SELECT order_id, 7, ord, 'fill', trade_id, qty FROM fills
    UNION ALL SELECT order_id, 8, 0, 'ack', 0, 0 FROM requests WHERE order_id % 3 = 1
    UNION ALL SELECT order_id, 9, 0, CASE order_id % 4 WHEN 0 THEN 'check_live' WHEN 1 THEN 'check_filled' WHEN 2 THEN 'check_cancelled' ELSE 'check_missing' END, 0, 0 FROM requests WHERE order_id % 3 = 2"""


@query("g18_unknown_status", _walk(
    f"""SELECT s.*, s.event = 'fill' AND s.rn > min(s.rn) OVER (PARTITION BY s.symbol, s.event, s.trade_id) AS again
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY moment, ord) AS rn FROM ({_UNKNOWN}) AS e) AS s""",
    "'None' AS status, 0::BIGINT AS filled, 0::BIGINT AS waiting, '' AS action",
    """CASE WHEN r.event = 'submit' THEN 'Pending' WHEN f.status IN ('Filled', 'Cancelled', 'None') THEN f.status
         WHEN r.event = 'tick' THEN CASE WHEN f.status = 'Pending' AND r.moment > 5 THEN 'UnknownStatus' ELSE f.status END
         WHEN r.event = 'fill' THEN CASE WHEN r.again OR f.status IN ('Pending', 'UnknownStatus') THEN f.status WHEN f.filled + r.qty >= 10000 THEN 'Filled' ELSE 'PartiallyFilled' END
         WHEN f.status IN ('Pending', 'UnknownStatus') AND r.event = 'ack' OR f.status = 'UnknownStatus' AND r.event = 'check_live'
           THEN CASE WHEN f.filled + f.waiting >= 10000 THEN 'Filled' WHEN f.filled + f.waiting > 0 THEN 'PartiallyFilled' ELSE 'New' END
         WHEN f.status = 'UnknownStatus' AND r.event = 'check_filled' THEN 'Filled' WHEN f.status = 'UnknownStatus' AND r.event IN ('check_cancelled', 'check_missing') THEN 'Cancelled' ELSE f.status END,
       CASE WHEN f.status IN ('New', 'PartiallyFilled') AND r.event = 'fill' AND NOT r.again THEN f.filled + r.qty WHEN f.status = 'UnknownStatus' AND r.event = 'check_filled' THEN 10000
         WHEN f.status IN ('Pending', 'UnknownStatus') AND r.event = 'ack' OR f.status = 'UnknownStatus' AND r.event = 'check_live' THEN f.filled + f.waiting ELSE f.filled END,
       CASE WHEN f.status IN ('Pending', 'UnknownStatus') AND r.event = 'fill' AND NOT r.again THEN f.waiting + r.qty
         WHEN f.status IN ('Pending', 'UnknownStatus') AND r.event = 'ack' OR f.status = 'UnknownStatus' AND r.event IN ('check_live', 'check_filled') THEN 0 ELSE f.waiting END,
       CASE WHEN r.event = 'submit' THEN 'Submitted' WHEN f.status IN ('Filled', 'Cancelled', 'None') THEN 'Ignored' WHEN r.event = 'tick' THEN CASE WHEN f.status = 'Pending' AND r.moment > 5 THEN 'ScheduleCheck' ELSE 'Ignored' END
         WHEN r.event = 'fill' THEN CASE WHEN r.again THEN 'Ignored' WHEN f.status IN ('Pending', 'UnknownStatus') THEN 'Buffered' ELSE 'ApplyFill' END
         WHEN f.status IN ('Pending', 'UnknownStatus') AND r.event = 'ack' OR f.status = 'UnknownStatus' AND r.event = 'check_live' THEN 'ApplyAck'
         WHEN f.status = 'UnknownStatus' AND r.event = 'check_filled' THEN 'ApplyFill' WHEN f.status = 'UnknownStatus' AND r.event IN ('check_cancelled', 'check_missing') THEN 'ApplyCancel' ELSE 'Ignored' END""",
    "r.symbol AS order_id, r.rn, r.event, f.status, f.filled AS filled_qty, f.waiting AS lost_or_waiting_qty, f.action"))
def unknown_status(v):
    r, f = v("requests"), v("fills")
    check = F.element_at(F.array(*map(F.lit, ("check_live", "check_filled", "check_cancelled", "check_missing"))), (F.col("order_id") % 4 + 1).cast("int"))
    zero = F.lit(0).cast("long")

    def rows(df, at, event, ord_=zero, trade=zero, qty=zero):
        return df.select(F.col("order_id").alias("symbol"), F.lit(at).cast("long").alias("moment"), ord_.cast("long").alias("ord"), event.alias("event"), trade.alias("trade_id"), qty.alias("qty"))

    acked, late, checked = (r.where(F.col("order_id") % 3 == i) for i in range(3))
    e = rows(r, 0, F.lit("submit")).unionByName(rows(acked, 1, F.lit("ack"))).unionByName(rows(r, 4, F.lit("tick"))).unionByName(rows(r, 6, F.lit("tick")))
    e = e.unionByName(rows(f, 7, F.lit("fill"), F.col("ord"), F.col("trade_id"), F.col("qty"))).unionByName(rows(late, 8, F.lit("ack"))).unionByName(rows(checked, 9, check))
    e = e.withColumn("ts_ns", F.col("moment") * folds.SECOND).withColumn("total_qty", F.lit(10_000).cast("long"))
    done = folds.run(e, folds.order_machine(), "symbol", ["moment", "ord"], [], _order_tasks(v), {"rn": _row_number})
    return done.select(F.col("symbol").alias("order_id"), "rn", "event", "status", "filled_qty", "lost_or_waiting_qty", "action")


@query("f13_current_orders", _walk(
    _NUMBERED, "'None' AS status, 0::BIGINT AS filled, NULL::BIGINT AS exchange, 0::BIGINT AS updated",
    """CASE WHEN r.event = 'submit' THEN 'Pending' WHEN f.status IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN f.status
         ELSE CASE r.event WHEN 'ack' THEN 'New' WHEN 'fill' THEN CASE WHEN r.trade_id % 5 = 0 THEN 'Filled' ELSE 'PartiallyFilled' END WHEN 'cancel' THEN 'Cancelled' WHEN 'reject' THEN 'Rejected' ELSE 'Expired' END END,
       CASE WHEN r.event = 'submit' THEN 0 WHEN r.event = 'fill' AND f.status NOT IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN f.filled + r.qty ELSE f.filled END,
       CASE WHEN r.event = 'submit' THEN NULL WHEN r.event = 'ack' AND f.status NOT IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN r.symbol * 10 ELSE f.exchange END,
       CASE WHEN r.event = 'submit' OR f.status NOT IN ('Filled', 'Cancelled', 'Rejected', 'Expired', 'None') THEN r.phase * 1000000000::BIGINT ELSE f.updated END""",
    "r.symbol AS order_id, f.status, f.filled AS filled_qty, f.exchange AS exchange_order, f.updated AS updated_ns", last=True))
def current_orders(v):
    e = _order_events(v).withColumn("exchange_id", F.col("symbol") * 10).withColumn("is_final", F.col("trade_id") % 5 == 0)
    last = {"last": lambda by: F.lead(F.lit(True)).over(by).isNull()}
    done = folds.run(e, folds.JOURNAL_ORDER, "symbol", ["phase", "ord"], [], _order_tasks(v), last)
    return done.where("last").select(F.col("symbol").alias("order_id"), "status", "filled_qty", "exchange_order", "updated_ns")
