"""Ordered folds by key: what windows cannot say, because some rows leave the state as it is.

A fold is a small function ``step(state, row) -> (state, outputs)``. In batch, rows are dealt by key and sorted inside partitions, and
one pass carries the state along: a key's rows stream through a task and are never gathered into one group. The streaming twin in
``streaming.stateful`` runs the same functions over stored state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Fold:
    """A fold: its start state (a flat tuple), its step, the columns that it reads, and those that it adds (DDL)."""

    start: tuple
    step: Callable
    reads: tuple[str, ...]
    adds: str
    state: str


def run(df: DataFrame, fold: Fold, key: str | list[str], order: list, keep: list[str] | None = None, tasks: int | None = None, beside: dict[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """The rows with the fold's columns. ``order`` must be total within a key; keys may be null, and are one key then. Only keys, order,
    what the fold reads and the columns ``keep`` go through Python; None keeps all.

    Rows are dealt to so many ``tasks`` (None: Spark's number of shuffle partitions, however many rows there are). ``beside`` names columns
    that windows over a key's rows in order give; they take the same shuffle and sort as the fold.
    """
    keys = [key] if isinstance(key, str) else key
    if keep is not None:
        df = df.select(*dict.fromkeys([*keys, *order, *fold.reads, *keep]))
    df = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    by = Window.partitionBy(*keys).orderBy(*order)
    for name, column in (beside or {}).items():
        df = df.withColumn(name, column(by))
    added = T.StructType.fromDDL(fold.adds)
    schema = T.StructType([*df.schema.fields, *added.fields])
    start, step, reads = fold.start, fold.step, fold.reads

    def carry(batches):
        last, state = None, start
        for pdf in batches:
            if not len(pdf):
                continue
            own = pdf[keys].reset_index(drop=True)
            before = own.shift()
            new = ~((own == before) | (own.isna() & before.isna())).all(axis=1)
            first = tuple(None if pd.isna(x) else x for x in own.iloc[0])
            new[0], last = first != last, tuple(None if pd.isna(x) else x for x in own.iloc[-1])
            out = []
            for changed, values in zip(new.tolist(), zip(*(pdf[c] for c in reads), strict=True), strict=True):
                state, row = step(start if changed else state, *values)
                out.append(row)
            columns = zip(added.fields, zip(*out, strict=True), strict=True)
            yield pdf.assign(**{f.name: pd.array(list(v), "Int64") if isinstance(f.dataType, T.LongType) else list(v) for f, v in columns})

    return df.sortWithinPartitions(*keys, *order).mapInPandas(carry, schema)


# -- sequences ---------------------------------------------------------------------------------------------------------------


def _sequence(futures: bool):
    def step(state, kind, first, final, prev):
        mode, last = state
        if kind == "snapshot":
            return ("bridging", int(final)), ("Snapshot", None, None)
        if mode in ("awaiting", "stale"):
            return state, ("Buffering", None, None)
        first, final, prev = int(first), int(final), int(prev)
        if mode == "bridging":
            if final <= last:
                return state, ("Discard", None, None)
            if first <= last + 1:
                return ("active", final), ("Apply", None, None)
            return ("stale", last), ("Gap", last if futures else last + 1, prev if futures else first)
        found, wanted = (prev, last) if futures else (first, last + 1)
        if found == wanted:
            return ("active", final), ("Apply", None, None)
        if found < wanted:
            return state, ("Discard", None, None)
        return ("stale", last), ("Gap", wanted, found)

    return step


_RESULT = "result string, expected long, actual long"
#: Update ids of a spot book: after a snapshot the first delta must bridge it, then each starts one past the last.
SPOT_SEQUENCE = Fold(("awaiting", 0), _sequence(False), ("kind", "first_id", "final_id", "prev_id"), _RESULT, "mode string, last long")
#: Of a futures book: each names the last id of the one before.
FUTURES_SEQUENCE = Fold(("awaiting", 0), _sequence(True), ("kind", "first_id", "final_id", "prev_id"), _RESULT, "mode string, last long")


def _book_top():
    """Keeps both sides as maps from price to quantity. A side's best price is looked for anew only when it is itself removed."""

    def change(side: dict, best, price, qty, pick):
        if qty > 0:
            side[price] = qty
            return price if best is None else pick(best, price)
        if side.pop(price, None) is not None and price == best:
            return pick(side) if side else None
        return best

    def step(state, kind, side, price, qty):
        bids, asks, bid, ask = state
        if kind == "snapshot":
            bids, asks, bid, ask = {}, {}, None, None
        bids, asks = (x if isinstance(x, dict) else dict(x) for x in (bids, asks))
        if side == "B":
            bid = change(bids, bid, int(price), int(qty), max)
        else:
            ask = change(asks, ask, int(price), int(qty), min)
        return (bids, asks, bid, ask), (bid, ask)

    return step


#: Best bid and ask after each update of a book; a snapshot's row begins a new book.
BOOK_TOP = Fold(((), (), None, None), _book_top(), ("kind", "side", "price", "qty"), "best_bid long, best_ask long", "bids array<struct<price:long,qty:long>>, asks array<struct<price:long,qty:long>>, bid long, ask long")


# -- timers and limits ---------------------------------------------------------------------------------------------------------


def bbo_timer(degrade_ns: int = SECOND // 4, stale_ns: int = SECOND) -> Fold:
    """How long the book's top has differed from the quoted one; matching or an empty side ends it, and so does MarkStale."""

    def step(state, now, book_bid, book_ask, bid, ask):
        (since,) = state
        if pd.isna(book_bid) or pd.isna(book_ask) or (book_bid == bid and book_ask == ask):
            return (-1,), ("Ok", 0)
        since = int(now) if since < 0 else since
        lasted = int(now) - since
        if lasted >= stale_ns:
            return (-1,), ("MarkStale", lasted)
        return (since,), ("Degrade" if lasted >= degrade_ns else "Ok", lasted)

    return Fold((-1,), step, ("ts_ns", "book_bid", "book_ask", "bid_price", "ask_price"), "action string, mismatch_ns long", "since long")


def circuit_breaker(attempts: int = 5, cooldown_ns: int = 30 * SECOND) -> Fold:
    """State before each attempt, and whether its failure opened the circuit. Success closes it; failures while open count nothing."""

    def step(state, now, ok):
        failures, until = state
        if until >= 0 and now >= until:
            failures, until = 0, -1
        before = "Open" if until >= 0 else "Closed"
        if ok:
            return (0, -1), (before, False, 0)
        if until >= 0:
            return (failures, until), (before, False, failures)
        failures += 1
        opened = failures >= attempts
        return (failures, int(now) + cooldown_ns if opened else -1), (before, opened, failures)

    return Fold((0, -1), step, ("ts_ns", "ok"), "state_before string, opened boolean, failures long", "failures long, until long")


def recovery_buffer(max_age_ns: int = 10 * SECOND, max_events: int = 2048, max_bytes: int = 4 << 20) -> Fold:
    """Accepted or the limit that overflows, tested in the order age, count, bytes. A row with ``drain`` empties the buffer first."""

    def step(state, drain, now, size):
        oldest, events, held = (-1, 0, 0) if drain else state
        if events and now - oldest > max_age_ns:
            return (oldest, events, held), ("Age", events)
        if events >= max_events:
            return (oldest, events, held), ("EventCount", events)
        if held + size > max_bytes:
            return (oldest, events, held), ("ByteSize", events)
        return (oldest if events else int(now), events + 1, held + int(size)), ("Accepted", events + 1)

    return Fold((-1, 0, 0), step, ("drain", "ts_ns", "size"), "outcome string, buffered long", "oldest long, events long, held long")


def backpressure(warn_ns: int = 100_000, degrade_ns: int = 1_000_000, restart_ns: int = 10_000_000) -> Fold:
    """Escalation by the time since the first of a run of refused offers."""

    def step(state, now, offer):
        (since,) = state
        if offer == "Ok":
            return (-1,), ("Accepted", 0)
        if offer in ("Closed", "MaxPositionExceeded"):
            return (-1,), ("Closed", 0)
        since = int(now) if since < 0 else since
        lasted = int(now) - since
        outcome = "Restart" if lasted >= restart_ns else "Degrade" if lasted >= degrade_ns else "Warned" if lasted >= warn_ns else "Retrying"
        return (since,), (outcome, lasted)

    return Fold((-1,), step, ("ts_ns", "offer"), "outcome string, elapsed_ns long", "since long")


def reconcile_schedule(period_ns: int = 60 * SECOND) -> Fold:
    """Which reconciliations are due after each event: startup and reconnect until completed, periodic when its time has come."""

    def step(state, now, event):
        startup, reconnect, due = state
        now = int(now)
        if event == "startup":
            startup, due = True, now + period_ns
        elif event == "reconnect":
            reconnect, due = True, due if due >= 0 else now + period_ns
        elif event == "startup_done":
            startup = False
        elif event == "reconnect_done":
            reconnect = False
        elif event == "periodic_done":
            due = now + period_ns
        names = [n for n, on in (("Startup", startup), ("Reconnect", reconnect), ("Periodic", 0 <= due <= now)) if on]
        return (startup, reconnect, due), (",".join(names),)

    return Fold((False, False, -1), step, ("ts_ns", "event"), "due string", "startup boolean, reconnect boolean, next_due long")


def checksum_arbiter(window: int = 64) -> Fold:
    """Verdict on each instance's checksum of a book version: the last ``window`` versions of a symbol are kept, oldest out first."""

    def step(state, instance, update_id, checksum):
        (kept,) = state
        kept = dict(kept)
        update_id = int(update_id)
        if kept and update_id < next(iter(kept)):
            return (tuple(kept.items()),), ("Stale",)
        active, passive = kept.get(update_id, (None, None))
        active, passive = (checksum, passive) if instance == 0 else (active, checksum)
        kept[update_id] = (active, passive)
        if len(kept) > window:
            kept.pop(next(iter(kept)))
        if active is None or passive is None:
            return (tuple(kept.items()),), ("Pending",)
        return (tuple(kept.items()),), ("Matched" if active == passive else "Diverged",)

    return Fold(((),), step, ("instance_id", "update_id", "checksum"), "verdict string", "kept array<struct<update_id:long,active:string,passive:string>>")


def _definition_change(state, body, trading):
    known, before, traded = state
    if not known:
        return (True, body, bool(trading)), ("Added", True)
    change = "Updated" if body != before else None
    return (True, body, bool(trading)), (change, bool(trading) != traded)


#: Changes of a symbol's definition, ``body`` being its compared fields as one text; for streams, where no window reaches back.
DEFINITION_CHANGE = Fold((False, "", False), _definition_change, ("body", "is_trading"), "change string, status_event boolean", "known boolean, body string, trading boolean")


# -- orders --------------------------------------------------------------------------------------------------------------------


def order_machine(timeout_ns: int = 5 * SECOND) -> Fold:
    """Status of an order after each event. Fills before the acknowledgement wait for it; a trade counts once; nothing leaves a
    terminal status; an order without an acknowledgement for longer than the timeout is unknown until one comes or a check tells.

    ``event`` is submit, ack, fill, cancel, reject, expire, tick, check_live, check_filled, check_cancelled or check_missing.
    """
    terminal = ("Filled", "Cancelled", "Rejected", "Expired")

    def status_of(filled, total):
        return "Filled" if filled >= total else "PartiallyFilled" if filled > 0 else "New"

    def step(state, now, event, trade, qty, total):
        status, filled, waiting, seen, since = state
        out = lambda s, f, w, n, t, action: ((s, f, w, n, t), (s, f, w, action))
        if event == "submit":
            return out("Pending", 0, 0, frozenset(), int(now), "Submitted")
        if status in terminal or status == "None":
            return out(status, filled, waiting, seen, since, "Ignored")
        early = status in ("Pending", "UnknownStatus")
        if event == "tick":
            late = status == "Pending" and now - since > timeout_ns
            return out("UnknownStatus" if late else status, filled, waiting, seen, since, "ScheduleCheck" if late else "Ignored")
        if event == "fill":
            if trade in seen:
                return out(status, filled, waiting, seen, since, "Ignored")
            seen = seen if isinstance(seen, set) else set(seen)
            seen.add(trade)  # the state before is not looked at again
            if early:
                return out(status, filled, waiting + int(qty), seen, since, "Buffered")
            filled += int(qty)
            return out("Filled" if filled >= total else "PartiallyFilled", filled, waiting, seen, since, "ApplyFill")
        if early and (event == "ack" or status == "UnknownStatus" and event == "check_live"):
            return out(status_of(filled + waiting, total), filled + waiting, 0, seen, since, "ApplyAck")
        if event == "cancel" or status == "UnknownStatus" and event in ("check_cancelled", "check_missing"):
            return out("Cancelled", filled, waiting, seen, since, "ApplyCancel")
        if event == "reject" and status != "UnknownStatus":
            return out("Rejected", filled, waiting, seen, since, "ApplyReject")
        if event == "expire" and not early:
            return out("Expired", filled, waiting, seen, since, "ApplyExpire")
        if status == "UnknownStatus" and event == "check_filled":
            return out("Filled", int(total), 0, seen, since, "ApplyFill")
        return out(status, filled, waiting, seen, since, "Ignored")

    return Fold(("None", 0, 0, frozenset(), 0), step, ("ts_ns", "event", "trade_id", "qty", "total_qty"), "status string, filled_qty long, lost_or_waiting_qty long, action string", "status string, filled long, waiting long, seen array<long>, since long")


def gateway() -> Fold:
    """The gateway's own record of an order: acknowledgements and cancels repeat without harm, other steps out of a terminal status
    are errors; a late acknowledgement sets a partly filled order back to New."""
    terminal = ("Filled", "Cancelled", "Rejected", "Expired")

    def step(state, event, qty, total):
        status, filled = state
        if event == "submit":
            return ("Pending", 0), ("Pending", 0, False)
        if event == "ack" and status == "New" or event == "cancel" and status == "Cancelled":
            return state, (status, filled, False)
        if status in terminal or status == "None":
            return state, (status, filled, True)
        if event == "fill":
            filled += int(qty)
            status = "Filled" if filled >= total else "PartiallyFilled"
        else:
            status = {"ack": "New", "cancel": "Cancelled", "reject": "Rejected", "expire": "Expired"}.get(event, status)
        return (status, filled), (status, filled, False)

    return Fold(("None", 0), step, ("event", "qty", "total_qty"), "status string, filled_qty long, invalid boolean", "status string, filled long")


#: Orders as a journal's records leave them; a request starts anew, nothing changes an order in a terminal status or without a request.
def _journal_order(state, now, event, exchange_id, qty, is_final):
    status, filled, exchange, updated = state
    if event == "submit":
        return ("Pending", 0, -1, int(now)), ("Pending", 0, None, int(now))
    if status not in ("None", "Filled", "Cancelled", "Rejected", "Expired"):
        if event == "fill":
            filled += int(qty)
        if event == "ack":
            exchange = int(exchange_id)
        status = {"ack": "New", "fill": "Filled" if is_final else "PartiallyFilled", "cancel": "Cancelled", "reject": "Rejected", "expire": "Expired"}[event]
        updated = int(now)
    return (status, filled, exchange, updated), (status, filled, exchange if exchange >= 0 else None, updated)


JOURNAL_ORDER = Fold(("None", 0, -1, 0), _journal_order, ("ts_ns", "event", "exchange_id", "qty", "is_final"), "status string, filled_qty long, exchange_order long, updated_ns long", "status string, filled long, exchange long, updated long")


def faults(drop: int, corrupt: int, duplicate: int, seed: int) -> Fold:
    """Fault injection of a replay by one seeded xorshift generator: each frame may be dropped, else one byte inverted, then sent twice."""
    mask = (1 << 64) - 1

    # fixed values: the generator's shifts, and its start where the seed is 0 (below)
    def draw(x):
        x ^= (x << 13) & mask
        x ^= x >> 7
        return x ^ ((x << 17) & mask)

    def chance(x, percent):
        if percent <= 0:
            return x, False
        x = draw(x)
        return x, x % 100 < percent

    def step(state, size):
        (x,) = state
        x, dropped = chance(x, drop)
        if dropped:
            return (x,), (0, None)
        x, spoilt = chance(x, corrupt)
        at = None
        if spoilt and size > 0:
            x = draw(x)
            at = x % int(size)
        x, twice = chance(x, duplicate)
        return (x,), (2 if twice else 1, at)

    return Fold((seed or 0xDEADBEEFCAFEF00D,), step, ("size",), "copies long, flipped_at long", "generator decimal(20,0)")


def heartbeat_gaps(df: DataFrame, key: str, limit_ns: int = SECOND) -> DataFrame:
    """Rows after which the next one of the key comes later than the limit, or never; by a window, since no state is needed."""
    after = F.lead("ts_ns").over(Window.partitionBy(key).orderBy("ts_ns", "event_id"))
    return df.withColumn("gap_ns", after - F.col("ts_ns")).where(F.col("gap_ns") > limit_ns)
