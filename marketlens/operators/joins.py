"""Joins of market data: enrichment, comparison of feeds, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def with_instruments(events: DataFrame, instruments: DataFrame) -> DataFrame:
    """Events with their instrument; those without one are dropped. Spark broadcasts the instruments if their bytes, as read, are few."""
    return events.join(instruments, "symbol")


def with_scales(events: DataFrame, scales: DataFrame, price_scale: int = 8, qty_scale: int = 8) -> DataFrame:
    """Events with their symbol's scales, or the defaults."""
    found = scales.select("symbol", F.col("price_scale").alias("_p"), F.col("qty_scale").alias("_q"))
    joined = events.join(found, "symbol", "left")
    return joined.withColumn("price_scale", F.coalesce("_p", F.lit(price_scale))).withColumn("qty_scale", F.coalesce("_q", F.lit(qty_scale))).drop("_p", "_q")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tie: str) -> DataFrame:
    """Left rows with the right table's latest values at or before their time, by key; null where there is none yet.

    Both sides are merged in time order and the last right values are carried forward, so one shuffle by key serves both. At equal
    times right rows come first, and of several the one with the largest ``tie``.
    """
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast("struct<" + ",".join(f"{v}:{right.schema[v].dataType.simpleString()}" for v in values) + ">").alias("_held"))
    b = right.select(key, time, tie, F.lit(0).alias("_side"), F.struct(*values).alias("_held"))
    merged = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(time, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_now", F.last("_held", ignorenulls=True).over(order)).where(F.col("_side") == 1)
    return carried.select(*left.columns, *[F.col(f"_now.{v}").alias(f"right_{v}") for v in values])


def checksum_pairs(checksums: DataFrame) -> DataFrame:
    """One row for each symbol and version: Matched, Diverged or Pending between the active instance (0) and the passive ones."""
    by = checksums.groupBy("symbol", "update_id").agg(
        F.max_by("checksum", F.when(F.col("instance_id") == 0, F.col("ord"))).alias("active"), F.max_by("checksum", F.when(F.col("instance_id") != 0, F.col("ord"))).alias("passive")
    )
    return by.withColumn("verdict", F.when(F.col("active").isNull() | F.col("passive").isNull(), "Pending").when(F.col("active") == F.col("passive"), "Matched").otherwise("Diverged"))


def reconcile_orders(exchange: DataFrame, tracked: DataFrame) -> DataFrame:
    """StillLive, Unexpected or Vanished for each order of the exchange's open list and of the tracked set."""
    both = exchange.select("cloid", F.lit(True).alias("_e")).join(tracked.select("cloid", F.lit(True).alias("_t")), "cloid", "full_outer")
    action = F.when(F.col("_e") & F.col("_t"), "StillLive").when(F.col("_e"), "Unexpected").otherwise("Vanished")
    return both.select("cloid", F.coalesce(action, F.lit("Vanished")).alias("action"))


def shadow_samples(active: DataFrame, shadow: DataFrame, tick_ns: int) -> DataFrame:
    """For each tick in which a symbol was updated on either side, both sides' latest prices at its end and their difference.

    Latest values are carried forward over ticks; a symbol is compared once both sides have spoken.
    """
    sides = []
    for df, name in ((active, "a"), (shadow, "s")):
        tick = S.div(F.col("ts_ns"), F.lit(tick_ns)).alias("tick")
        sides.append(df.groupBy("symbol", tick).agg(F.max_by(F.struct("bid_price", "ask_price"), F.struct("ts_ns", "update_id")).alias(name)))
    ticks = sides[0].join(sides[1], ["symbol", "tick"], "full_outer")
    so_far = Window.partitionBy("symbol").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    held = ticks.select("symbol", "tick", F.last("a", True).over(so_far).alias("a"), F.last("s", True).over(so_far).alias("s")).where(F.col("a").isNotNull() & F.col("s").isNotNull())
    return held.select("symbol", "tick", S.bps(F.col("a.bid_price"), F.col("s.bid_price")).alias("bid_bps"), S.bps(F.col("a.ask_price"), F.col("s.ask_price")).alias("ask_bps"))


def shadow_stats(samples: DataFrame, tolerance_bps: int) -> DataFrame:
    """Samples, divergences and largest differences by symbol."""
    apart = (F.col("bid_bps") > tolerance_bps) | (F.col("ask_bps") > tolerance_bps)
    return samples.groupBy("symbol").agg(F.count(F.lit(1)).alias("samples"), F.count_if(apart).alias("divergences"), F.max("bid_bps").alias("max_bid_bps"), F.max("ask_bps").alias("max_ask_bps"))


def shadow_verdict(stats: DataFrame, min_samples: int, allowed_percent: float) -> DataFrame:
    """One row: InsufficientData below the total of samples, else Diverging with the worst symbol over the allowed share, else Stable;
    with the process's exit code."""
    worst = F.greatest("max_bid_bps", "max_ask_bps")
    bad = (S.percentage(F.col("divergences"), F.col("samples")) > allowed_percent) & (worst > 0)
    # of equally bad symbols the first by name
    one = stats.groupBy().agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), F.min(F.when(bad, F.struct((-worst).alias("w"), F.col("symbol").alias("s")))).alias("worst"))
    few = F.col("samples") < min_samples
    verdict = F.when(few, "InsufficientData").when(F.col("worst").isNotNull(), "Diverging").otherwise("Stable")
    shown = F.col("worst").isNotNull() & ~few
    return one.select(
        "samples",
        verdict.alias("verdict"),
        F.when(shown, F.col("worst.s")).alias("worst_symbol"),
        F.when(shown, -F.col("worst.w")).alias("worst_bps"),
        F.when(few, 2).when(F.col("worst").isNotNull(), 1).otherwise(0).alias("exit_code"),
    )


def orders_with_fills(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders, each with its fills as an array in the order of trades; an empty one without."""
    listed = fills.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("trade_id", "price", "qty"))).alias("fills"))
    empty = F.array().cast(listed.schema["fills"].dataType)
    return orders.join(listed, "order_id", "left").withColumn("fills", F.coalesce("fills", empty))


def untracked_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills of orders that are not tracked."""
    return fills.join(orders.select("order_id"), "order_id", "left_anti")


def missing_names(places: DataFrame, present: DataFrame, place: str, wanted: tuple[str, ...]) -> DataFrame:
    """(place, name): those of the wanted names that each place lacks in ``present``, which has both columns."""
    needed = places.select(place, F.explode(F.array(*map(F.lit, wanted))).alias("name"))
    return needed.join(present, [place, "name"], "left_anti")


def top_of_book(levels: DataFrame, n: int) -> DataFrame:
    """The best ``n`` levels of each symbol's sides with their rank from 1: bids ('B') from the highest, asks ('A') from the lowest."""
    better = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    ranked = levels.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(better)).cast("long"))
    return ranked.where(F.col("rank") <= n)


def compare_levels(book: DataFrame, snapshot: DataFrame, n: int = 5, tolerance: int = 0, check_qty: bool = False) -> DataFrame:
    """Mismatches by symbol and side between two books' best ``n`` levels, paired by rank as far as the shorter side reaches."""
    a = top_of_book(book, n).select("symbol", "side", "rank", "price", "qty")
    b = top_of_book(snapshot, n).select("symbol", "side", "rank", F.col("price").alias("price_2"), F.col("qty").alias("qty_2"))
    differs: Column = F.abs(F.col("price") - F.col("price_2")) > tolerance
    differs = differs | (F.col("qty") != F.col("qty_2")) if check_qty else differs
    return a.join(b, ["symbol", "side", "rank"]).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("compared"), F.count_if(differs).alias("mismatches"))


def bridging(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Deltas that come after their symbol's snapshot, and whether each bridges it."""
    found = deltas.join(snapshots.select("symbol", "snapshot_id"), "symbol").where(F.col("final_id") > F.col("snapshot_id"))
    return found.withColumn("bridges", F.col("first_id") <= F.col("snapshot_id") + 1)
