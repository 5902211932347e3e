"""Boundary vectors of the ordered folds, step by step."""

import pytest

from marketlens.operators import folds

MS = 1_000_000


def walk(fold, rows):
    state, out = fold.start, []
    for r in rows:
        state, o = fold.step(state, *r)
        out.append(o)
    return out


def snap(i):
    return ("snapshot", 0, i, 0)


def delta(first, final, prev=0):
    return ("delta", first, final, prev)


@pytest.mark.parametrize("rows, wanted", [
    ([delta(1, 5)], "Buffering"),
    ([snap(100), delta(95, 100)], "Discard"),
    ([snap(200), delta(180, 199)], "Discard"),
    ([snap(100), delta(101, 105)], "Apply"),
    ([snap(100), delta(98, 103)], "Apply"),
    ([snap(100), delta(100, 101)], "Apply"),
    ([snap(0), delta(1, 10), delta(11, 20), delta(21, 30)], "Apply"),
    ([snap(10), delta(11, 20), delta(15, 20)], "Discard"),
])
def test_spot_sequence(rows, wanted):
    assert walk(folds.SPOT_SEQUENCE, rows)[-1][0] == wanted


def test_spot_gaps_name_what_was_expected():
    assert walk(folds.SPOT_SEQUENCE, [snap(100), delta(103, 107)])[-1] == ("Gap", 101, 103)
    assert walk(folds.SPOT_SEQUENCE, [snap(10), delta(11, 20), delta(23, 30)])[-1] == ("Gap", 21, 23)
    # a discarded overlap leaves the state alone; after a gap all waits for a snapshot
    assert [o[0] for o in walk(folds.SPOT_SEQUENCE, [snap(10), delta(11, 50), delta(40, 55), delta(51, 60), delta(70, 80), delta(61, 69), snap(90)])] == ["Snapshot", "Apply", "Discard", "Apply", "Gap", "Buffering", "Snapshot"]


@pytest.mark.parametrize("rows, wanted", [
    ([delta(1, 5, 0)], "Buffering"),
    ([snap(20), delta(15, 25, 14), delta(26, 30, 25)], "Apply"),
    ([snap(200), delta(190, 200, 1), delta(199, 210, 9), delta(300, 500, 210)], "Apply"),
    ([snap(20), delta(18, 21, 17), delta(26, 35, 25)], "Gap"),
    ([snap(20), delta(18, 21, 17), delta(16, 22, 15)], "Discard"),
])
def test_futures_sequence(rows, wanted):
    assert walk(folds.FUTURES_SEQUENCE, rows)[-1][0] == wanted


def test_bbo_timer_thresholds():
    rows = [(t * MS, 1, 2, 9, 2) for t in (0, 249, 250, 999, 1000, 1001)]
    assert [o[0] for o in walk(folds.bbo_timer(), rows)] == ["Ok", "Ok", "Degrade", "Degrade", "MarkStale", "Ok"]
    cleared = [(0, 1, 2, 9, 2), (300 * MS, None, 2, 9, 2), (400 * MS, 1, 2, 9, 2), (500 * MS, 1, 2, 1, 3), (2000 * MS, 1, 2, 1, 2)]
    assert [o[0] for o in walk(folds.bbo_timer(), cleared)] == ["Ok", "Ok", "Ok", "Ok", "Ok"]


def test_circuit_breaker():
    s = folds.SECOND
    out = walk(folds.circuit_breaker(), [(i, False) for i in range(5)] + [(10, False), (30 * s + 3, False), (30 * s + 4, False), (30 * s + 5, True)])
    assert [o[1] for o in out] == [False] * 4 + [True] + [False] * 4
    assert [o[0] for o in out] == ["Closed"] * 5 + ["Open", "Open", "Closed", "Closed"]


def test_recovery_buffer_limits():
    s = folds.SECOND
    assert [o[0] for o in walk(folds.recovery_buffer(), [(True, 0, 10), (False, 10 * s, 10), (False, 10 * s + 1, 10)])] == ["Accepted", "Accepted", "Age"]
    assert [o[0] for o in walk(folds.recovery_buffer(max_events=2), [(True, 0, 1), (False, 0, 1), (False, 0, 1), (False, 11 * s, 1), (True, 0, 1)])] == ["Accepted", "Accepted", "EventCount", "Age", "Accepted"]
    assert [o[0] for o in walk(folds.recovery_buffer(max_bytes=10), [(True, 0, 6), (False, 0, 4), (False, 0, 1)])] == ["Accepted", "Accepted", "ByteSize"]


def test_backpressure():
    out = walk(folds.backpressure(), [(0, "BackPressured"), (99_999, "AdminAction"), (100_000, "BackPressured"), (1_000_000, "BackPressured"), (10_000_000, "BackPressured"), (10_000_001, "Ok"), (10_000_002, "BackPressured"), (10_000_003, "Closed")])
    assert [o[0] for o in out] == ["Retrying", "Retrying", "Warned", "Degrade", "Restart", "Accepted", "Retrying", "Closed"]


def test_checksum_arbiter_window():
    fold = folds.checksum_arbiter(window=2)
    out = walk(fold, [(0, 5, "a"), (1, 5, "a"), (0, 6, "b"), (1, 6, "c"), (0, 7, "d"), (1, 5, "a"), (1, 7, "d")])
    assert [o[0] for o in out] == ["Pending", "Matched", "Pending", "Diverged", "Pending", "Stale", "Matched"]


def test_order_machine():
    t = folds.SECOND

    def run(*events):
        return walk(folds.order_machine(), [(ts, e, trade, qty, 100) for ts, e, trade, qty in events])

    assert run((0, "submit", 0, 0), (1, "fill", 7, 40), (2, "fill", 7, 40), (3, "ack", 0, 0), (4, "fill", 8, 60), (5, "cancel", 0, 0))[-1][:2] == ("Filled", 100)
    # fills that wait are lost when a cancel comes before the acknowledgement
    assert run((0, "submit", 0, 0), (1, "fill", 7, 40), (2, "cancel", 0, 0))[-1][:3] == ("Cancelled", 0, 40)
    assert [o[0] for o in run((0, "submit", 0, 0), (5 * t, "tick", 0, 0), (5 * t + 1, "tick", 0, 0), (6 * t, "check_live", 0, 0))] == ["Pending", "Pending", "UnknownStatus", "New"]


def test_gateway_errors_and_late_acks():
    out = walk(folds.gateway(), [("submit", 0, 100), ("ack", 0, 100), ("ack", 0, 100), ("fill", 40, 100), ("ack", 0, 100), ("fill", 60, 100), ("cancel", 0, 100)])
    assert [o[0] for o in out] == ["Pending", "New", "New", "PartiallyFilled", "New", "Filled", "Filled"] and out[-1][2] and not out[4][2]


def test_reconcile_schedule():
    s = folds.SECOND
    out = walk(folds.reconcile_schedule(), [(0, "startup"), (1, "startup_done"), (2, "reconnect"), (3, "reconnect_done"), (60 * s, "tick"), (61 * s, "periodic_done"), (62 * s, "tick")])
    assert [o[0] for o in out] == ["Startup", "", "Reconnect", "", "Periodic", "", ""]


def test_faults_repeat_with_the_seed():
    rows = [(10,)] * 200
    assert walk(folds.faults(30, 20, 10, 7), rows) == walk(folds.faults(30, 20, 10, 7), rows)
    assert walk(folds.faults(0, 0, 0, 1), rows) == [(1, None)] * 200
    assert walk(folds.faults(100, 0, 0, 1), rows) == [(0, None)] * 200
    assert all(c == 2 and a is not None for c, a in walk(folds.faults(0, 100, 100, 1), rows))
