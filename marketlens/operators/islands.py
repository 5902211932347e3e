"""Runs of rows of a key by windows: how long a condition has lasted, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds


def lasting(rows: DataFrame, key: str, order: list[str], time: str, holds: Column) -> DataFrame:
    """Rows with ``_holds``, and ``_since``: the time at which the present run of rows that hold began, null where it does not hold."""
    by = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    starts = F.col("_holds") & ~F.coalesce(F.lag("_holds").over(by), F.lit(False))
    began = F.last(F.when(F.col("_starts"), F.col(time)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_starts", starts).withColumn("_since", F.when(F.col("_holds"), began)).drop("_starts")


def backpressure(offers: DataFrame, warn_ns: int, degrade_ns: int, restart_ns: int, key: str = "symbol") -> DataFrame:
    """``folds.backpressure`` by windows: ``outcome`` and ``elapsed_ns`` of each offer, by the time since the first of a run of refused
    ones."""
    ended = F.col("offer").isin("Closed", "MaxPositionExceeded")
    run = lasting(offers, key, ["ts_ns", "event_id"], "ts_ns", ~((F.col("offer") == "Ok") | ended))
    elapsed = F.coalesce(F.col("ts_ns") - F.col("_since"), F.lit(0))
    level = F.when(elapsed >= restart_ns, "Restart").when(elapsed >= degrade_ns, "Degrade").when(elapsed >= warn_ns, "Warned").otherwise("Retrying")
    outcome = F.when(F.col("offer") == "Ok", "Accepted").when(ended, "Closed").otherwise(level)
    return run.withColumn("outcome", outcome).withColumn("elapsed_ns", elapsed).drop("_holds", "_since")


def bbo_timer(quotes: DataFrame, degrade_ns: int, stale_ns: int, key: str = "symbol") -> DataFrame:
    """``folds.bbo_timer`` by windows: ``action`` and ``mismatch_ns`` of each quote, by how long the book's top has differed.

    Reaching ``stale_ns`` starts the time anew, so a run's later rows hang on its earlier ones; only runs that last that long go through
    the fold, each by itself.
    """
    differs = F.col("book_bid").isNotNull() & F.col("book_ask").isNotNull() & ~((F.col("book_bid") == F.col("bid_price")) & (F.col("book_ask") == F.col("ask_price")))
    run = lasting(quotes, key, ["ts_ns", "event_id"], "ts_ns", differs)
    lasted = F.coalesce(F.col("ts_ns") - F.col("_since"), F.lit(0))
    whole = Window.partitionBy(key, "_since")
    run = run.withColumn("mismatch_ns", lasted).withColumn("_long", F.col("_holds") & (F.max("ts_ns").over(whole) - F.col("_since") >= stale_ns))
    short = run.where(~F.col("_long")).withColumn("action", F.when(F.col("mismatch_ns") >= degrade_ns, "Degrade").otherwise("Ok"))
    long = folds.run(run.where("_long").drop("mismatch_ns"), folds.bbo_timer(degrade_ns, stale_ns), [key, "_since"], ["ts_ns", "event_id"])
    return short.drop("_holds", "_since", "_long").unionByName(long.drop("_holds", "_since", "_long"))
