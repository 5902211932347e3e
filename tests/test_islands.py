"""Runs by windows against the folds that walk them."""

import random

from marketlens.operators import folds, islands


def test_runs_are_those_of_the_folds(spark):
    rng = random.Random(6)
    offers, quotes = [], []
    for symbol in "AB":
        at = 0
        for i in range(400):
            at += rng.choice([0, 1, 3, 10])
            offers.append((symbol, i, at, rng.choice(["Ok", "Closed", "MaxPositionExceeded", *["BackPressured"] * 9, *["AdminAction"] * 9])))
            bid = rng.choice([None, 5, 6, 6, 6, 6, 6, 6])
            quotes.append((symbol, i, at, bid, rng.choice([None, 9, 9, 9, 9, 9]), 5, 9))
    df = spark.createDataFrame(offers, "symbol string, event_id long, ts_ns long, offer string")
    columns = ("symbol", "event_id", "outcome", "elapsed_ns")
    want = folds.run(df, folds.backpressure(5, 20, 40), "symbol", ["ts_ns", "event_id"])
    assert sorted(map(repr, islands.backpressure(df, 5, 20, 40).select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    df = spark.createDataFrame(quotes, "symbol string, event_id long, ts_ns long, book_bid long, book_ask long, bid_price long, ask_price long")
    columns = ("symbol", "event_id", "action", "mismatch_ns")
    for limits in ((5, 20), (3, 6), (10, 1000)):
        want = folds.run(df, folds.bbo_timer(*limits), "symbol", ["ts_ns", "event_id"]).select(*columns).collect()
        assert sorted(map(repr, islands.bbo_timer(df, *limits).select(*columns).collect())) == sorted(map(repr, want))
        assert limits[1] > 100 or any(r["action"] == "MarkStale" for r in want)
