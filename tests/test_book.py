"""Books against a plain model, over generated updates, and the invariants that hold for any of them."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import generate
from marketlens.operators import book, folds, joins, normalise


def plain(rows):
    """Levels at the end and tops along the way of one symbol's updates in order."""
    sides, tops = {"B": {}, "A": {}}, []
    for kind, side, price, qty in rows:
        if kind == "snapshot":
            sides = {"B": {}, "A": {}}
        sides[side].pop(price, None)
        if qty > 0:
            sides[side][price] = qty
        tops.append((max(sides["B"], default=None), min(sides["A"], default=None)))
    return sides, tops


UPDATE = st.tuples(st.sampled_from(["delta"] * 9 + ["snapshot"]), st.sampled_from("BA"), st.integers(1, 6), st.integers(0, 3))


@settings(max_examples=300, deadline=None)
@given(st.lists(UPDATE, max_size=40))
def test_top_fold_is_the_plain_book(rows):
    state, out = folds.BOOK_TOP.start, []
    for r in rows:
        state, o = folds.BOOK_TOP.step(state, *r)
        out.append(o)
    assert out == plain(rows)[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_books_of_many_symbols(spark, seed):
    rng = random.Random(seed)
    rows = {f"S{s}": [(rng.choice(["delta"] * 30 + ["snapshot"]), rng.choice("BA"), rng.randrange(1, 30), rng.randrange(4)) for _ in range(150)] for s in range(6)}
    df = spark.createDataFrame([(s, n, *u) for s, us in rows.items() for n, u in enumerate(us, 1)], "symbol string, n long, kind string, side string, price long, qty long").repartition(5)
    got = {(r["symbol"], r["side"], r["price"]): r["qty"] for r in book.latest_levels(df).collect()}
    assert got == {(s, side, p): q for s, us in rows.items() for side, levels in plain(us)[0].items() for p, q in levels.items()}
    tops = {(r["symbol"], r["n"]): (r["best_bid"], r["best_ask"]) for r in book.tops(df).collect()}
    assert tops == {(s, n): t for s, us in rows.items() for n, t in enumerate(plain(us)[1], 1)}


@pytest.mark.parametrize("symbols", [1, 10, 100])
def test_generated_books_hold_the_invariants(spark, symbols):
    updates = generate.deltas(spark, symbols, 120)
    levels = book.latest_levels(updates)
    assert book.violations(levels).count() == 0 and levels.where("qty <= 0").count() == 0
    outcome = normalise.recovery_outcomes(updates).agg(F.sum("replayed"), F.sum("discarded"), F.bool_or("failed")).first()
    assert tuple(outcome) == (symbols * 119, 0, False)
    # the last id only grows
    judged = folds.run(updates, folds.FUTURES_SEQUENCE, "symbol", ["n"])
    assert judged.where("result not in ('Apply', 'Snapshot')").count() == 0


def test_level_comparison(spark):
    a = generate.snapshots(spark, 3, depth=8)
    assert joins.compare_levels(a, a).agg(F.sum("mismatches")).first()[0] == 0
    moved = a.withColumn("price", F.when((F.col("symbol") == "SYM000002") & (F.col("side") == "B"), F.col("price") - 1).otherwise(F.col("price")))
    bad = {(r["symbol"], r["side"]): (r["compared"], r["mismatches"]) for r in joins.compare_levels(a, moved).collect()}
    assert bad[("SYM000002", "B")] == (5, 5) and bad[("SYM000001", "B")] == (5, 0)
    assert joins.compare_levels(a, moved, tolerance=1).agg(F.sum("mismatches")).first()[0] == 0
    short = a.where("side = 'B'")
    assert joins.compare_levels(a, short).where("side = 'A'").count() == 0
