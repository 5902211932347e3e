"""Keyed state with timers and maps: orders that silence makes unknown, books by price level, checksums of two feeds.

These run on ``transformWithState`` and so on the RocksDB state store (``state_store`` sets it). A row's state is read and written by the
entry, not as a whole, and what is finished is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import folds

MILLISECOND = 1_000_000


def state_store(spark: SparkSession) -> None:
    """Have the session's next streaming queries keep state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Orders(StatefulProcessor):
    """``folds.order_machine`` over a value, and event-time timers in place of ticks.

    A timer stands at the end of the time that an order may wait for an answer; another one, set when the order is unknown, at the end
    of the time that it is kept. A trigger gives rows before timers, so a row from after the waiting time makes the order unknown first.
    An order in a terminal status has neither timers nor state.
    """

    def __init__(self, timeout_ns: int, keep_ns: int):
        self.fold, self.timeout, self.keep = folds.order_machine(timeout_ns), timeout_ns, keep_ns

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("order", self.fold.state)

    def _now(self):
        status, filled, waiting, seen, since = self.state.get()
        return status, filled, waiting, frozenset(seen), since

    def _put(self, state):
        status, filled, waiting, seen, since = state
        if status in ("Filled", "Cancelled", "Rejected", "Expired"):
            self.state.clear()
            self._stop()
        else:
            self.state.update((status, filled, waiting, sorted(seen), since))

    def _stop(self):
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _unknown(self, key, before):
        due = before[4] + self.timeout
        after, (status, filled, waiting, action) = self.fold.step(before, due + 1, "tick", None, 0, 0)
        self._put(after)
        self._stop()
        self.handle.registerTimer((due + self.keep) // MILLISECOND)
        return Row(order_id=key[0], ts_ns=due, event="silence", status=status, filled_qty=filled, lost_or_waiting_qty=waiting, action=action)

    def handleInputRows(self, key, rows, timerValues):
        for row in sorted(rows, key=lambda r: (r["ts_ns"], r["ord"])):
            known = self.state.exists()
            before = self._now() if known else self.fold.start
            if before[0] == "Pending" and row["ts_ns"] > before[4] + self.timeout:
                yield self._unknown(key, before)
                before = self._now()
            after, (status, filled, waiting, action) = self.fold.step(before, *(row[c] for c in self.fold.reads))
            if known or row["event"] == "submit":
                self._put(after)
            if row["event"] == "submit":
                self._stop()
                self.handle.registerTimer(-(-(row["ts_ns"] + self.timeout) // MILLISECOND))
            elif before[0] in ("Pending", "UnknownStatus") and status != before[0]:
                self._stop()
            yield Row(order_id=key[0], ts_ns=row["ts_ns"], event=row["event"], status=status, filled_qty=filled, lost_or_waiting_qty=waiting, action=action)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs() * MILLISECOND
        before = self._now()
        if before[0] == "UnknownStatus":
            self.state.clear()
            yield Row(order_id=key[0], ts_ns=at, event="forget", status=before[0], filled_qty=before[1], lost_or_waiting_qty=before[2], action="Forgotten")
            return
        if before[0] == "Pending":
            yield self._unknown(key, before)


def orders(events: DataFrame, timeout_ns: int, keep_ns: int, allowance: str) -> DataFrame:
    """Status of each order after each event (order_id, ts_ns, ord, event, trade_id, qty, total_qty), and a row with event ``silence``
    once event time has passed the end of an order's waiting time without an answer; ``ts_ns`` is that end. An unknown order is forgotten
    after ``keep_ns`` more. Rows later than the allowance are dropped, so a timer is never overtaken by an answer in time."""
    stream = events.withColumn("_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1_000))).withWatermark("_time", allowance)
    out = "order_id long, ts_ns long, event string, status string, filled_qty long, lost_or_waiting_qty long, action string"
    return stream.groupBy("order_id").transformWithState(_Orders(timeout_ns, keep_ns), T.StructType.fromDDL(out), "append", "EventTime")


class _Book(StatefulProcessor):
    """Quantities by price, a map a side, and the best price of each side. An update writes one entry; all prices of a side are read
    only when its best one goes."""

    def init(self, handle):
        self.bids, self.asks = (handle.getMapState(side, "price long", "qty long") for side in ("bids", "asks"))
        self.best = handle.getValueState("best", "bid long, ask long")

    def _change(self, side, best, price, qty, pick):
        if qty > 0:
            side.updateValue((price,), (qty,))
            return price if best is None else pick(best, price)
        if side.containsKey((price,)):
            side.removeKey((price,))
            if price == best:
                return pick((k[0] for k in side.keys()), default=None)
        return best

    def handleInputRows(self, key, rows, timerValues):
        bid, ask = self.best.get() if self.best.exists() else (None, None)
        for row in sorted(rows, key=lambda r: r["n"]):
            if row["kind"] == "snapshot":
                self.bids.clear()
                self.asks.clear()
                bid = ask = None
            if row["side"] == "B":
                bid = self._change(self.bids, bid, row["price"], row["qty"], max)
            else:
                ask = self._change(self.asks, ask, row["price"], row["qty"], min)
            yield Row(symbol=key[0], n=row["n"], best_bid=bid, best_ask=ask)
        self.best.update((bid, ask))


def book_tops(updates: DataFrame) -> DataFrame:
    """Best bid and ask after each update (symbol, n, kind, side, price, qty), as ``book.tops`` has them."""
    return updates.groupBy("symbol").transformWithState(_Book(), T.StructType.fromDDL("symbol string, n long, best_bid long, best_ask long"), "append", "None")


class _Arbiter(StatefulProcessor):
    """The last versions of a symbol's book that either feed has sent a checksum of: a map from update id to both checksums and its place,
    and a map from place to update id, which gives the oldest one. Both hold ``window`` entries at most."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle):
        self.kept = handle.getMapState("kept", "update_id long", "active string, passive string, place long")
        self.order = handle.getMapState("order", "place long", "update_id long")
        self.ends = handle.getValueState("ends", "first long, last long")

    def handleInputRows(self, key, rows, timerValues):
        first, last = self.ends.get() if self.ends.exists() else (0, 0)  # places held are first to last - 1
        for row in sorted(rows, key=lambda r: r["ord"]):
            id_ = row["update_id"]
            if last > first and id_ < self.order.getValue((first,))[0]:
                yield Row(symbol=key[0], ord=row["ord"], update_id=id_, verdict="Stale")
                continue
            known = self.kept.containsKey((id_,))
            active, passive, place = self.kept.getValue((id_,)) if known else (None, None, last)
            active, passive = (row["checksum"], passive) if row["instance_id"] == 0 else (active, row["checksum"])
            self.kept.updateValue((id_,), (active, passive, place))
            if not known:
                self.order.updateValue((last,), (id_,))
                last += 1
                if last - first > self.window:
                    self.kept.removeKey((self.order.getValue((first,))[0],))
                    self.order.removeKey((first,))
                    first += 1
            verdict = "Pending" if active is None or passive is None else "Matched" if active == passive else "Diverged"
            yield Row(symbol=key[0], ord=row["ord"], update_id=id_, verdict=verdict)
        self.ends.update((first, last))


def verdicts(active: DataFrame, passive: DataFrame, window: int = 64) -> DataFrame:
    """Two streams of checksums (symbol, ord, update_id, checksum) against each other: a verdict on each row, as the fold
    ``folds.checksum_arbiter`` gives it. Unlike a join of streams, whose state is bounded by time, a row waits for its other side until
    ``window`` later versions have come. Within a trigger rows are taken by ``ord``."""
    columns = ("symbol", "ord", "update_id", "checksum")
    both = active.select(*columns, F.lit(0).alias("instance_id")).unionByName(passive.select(*columns, F.lit(1).alias("instance_id")))
    return both.groupBy("symbol").transformWithState(_Arbiter(window), T.StructType.fromDDL("symbol string, ord long, update_id long, verdict string"), "append", "None")
