"""Order books from deltas: final state, tops along the way, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import folds


def latest_levels(updates: DataFrame) -> DataFrame:
    """The book of each symbol after all updates (symbol, n, kind, side, price, qty): the last quantity at each price since the last
    snapshot, without those that are 0. A snapshot's own row belongs to the new book. Only keyed aggregates, so hot symbols combine
    before the shuffle.
    """
    since = updates.where(F.col("kind") == "snapshot").groupBy("symbol").agg(F.max("n").alias("_since"))
    kept = updates.join(since, "symbol", "left").where(F.col("n") >= F.coalesce("_since", F.lit(0)))
    last = kept.groupBy("symbol", "side", "price").agg(F.max_by("qty", "n").alias("qty"))
    return last.where(F.col("qty") > 0)


def tops(updates: DataFrame, tasks: int | None = None) -> DataFrame:
    """Best bid and ask after each update, as of the levels standing then: one pass over each symbol's rows in order."""
    return folds.run(updates, folds.BOOK_TOP, "symbol", ["n"], tasks=tasks).select("symbol", "n", "best_bid", "best_ask")


def depths(levels: DataFrame) -> DataFrame:
    """Levels on each side, and whether a side is empty."""
    both = levels.groupBy("symbol").agg(F.count_if(F.col("side") == "B").alias("bid_depth"), F.count_if(F.col("side") == "A").alias("ask_depth"))
    return both.withColumn("one_sided", (F.col("bid_depth") == 0) | (F.col("ask_depth") == 0))


def best(levels: DataFrame) -> DataFrame:
    """Best bid and ask with their quantities."""
    bid, ask = F.col("side") == "B", F.col("side") == "A"
    return levels.groupBy("symbol").agg(
        F.max(F.when(bid, F.col("price"))).alias("bid_price"),
        F.max_by("qty", F.when(bid, F.col("price"))).alias("bid_qty"),
        F.min(F.when(ask, F.col("price"))).alias("ask_price"),
        F.min_by("qty", F.when(ask, F.col("price"))).alias("ask_qty"),
    )


def violations(levels: DataFrame) -> DataFrame:
    """Symbols whose book is crossed or holds a quantity that is not positive."""
    b = levels.groupBy("symbol").agg(
        F.max(F.when(F.col("side") == "B", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "A", F.col("price"))).alias("best_ask"), F.count_if(F.col("qty") <= 0).alias("bad_qty")
    )
    return b.withColumn("crossed", F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False))).where(F.col("crossed") | (F.col("bad_qty") > 0))


def checksums(levels: DataFrame, versions: DataFrame) -> DataFrame:
    """The checksum of each symbol's book with its last update id (symbol, update_id)."""
    level = F.struct("price", "qty")
    sides = levels.groupBy("symbol").agg(F.collect_list(F.when(F.col("side") == "B", level)).alias("bids"), F.collect_list(F.when(F.col("side") == "A", level)).alias("asks"))
    return versions.join(sides, "symbol").select("symbol", "update_id", F.size("bids").cast("long").alias("bid_depth"), F.size("asks").cast("long").alias("ask_depth"), S.book_checksum(F.col("update_id"), F.col("bids"), F.col("asks")).alias("checksum"))
