"""Synthetic order books for tests at any scale: every value is a function of its place, so partitions need not agree on anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Middle price, tick, and largest quantity of the generated books
MID, TICK, MOST_QTY = 100_000, 100, 1_000


def snapshots(spark: SparkSession, symbols: int, depth: int = 10, seed: int = 1, spread: int = 1, sides: str = "BA") -> DataFrame:
    """Levels (symbol, side, price, qty) of ``symbols`` books; ``spread`` ticks between the middle and the best prices."""
    rows = spark.range(1, symbols + 1).withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides]))).withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth - 1).cast("long"))))
    away = (F.col("l") + spread) * TICK
    price = F.when(F.col("side") == "B", F.lit(MID) - away).otherwise(F.lit(MID) + away)
    qty = F.lit(1) + F.pmod(F.xxhash64("id", "side", "l", F.lit(seed)), F.lit(MOST_QTY))
    return rows.select(F.format_string("SYM%06d", "id").alias("symbol"), "side", price.alias("price"), qty.alias("qty"))


def deltas(spark: SparkSession, symbols: int, updates: int, seed: int = 1, zeros_in: int = 5) -> DataFrame:
    """``updates`` rows for each symbol in order (symbol, n, kind, first_id, final_id, prev_id, side, price, qty); one in ``zeros_in``
    removes its level; the first is a snapshot row."""
    rows = spark.range(1, symbols + 1).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(updates).cast("long"))))
    draw = lambda salt, most: F.pmod(F.xxhash64("id", "n", F.lit(seed), F.lit(salt)), F.lit(most))
    side = F.when(draw("side", 2) == 0, "B").otherwise("A")
    away = (draw("price", 10) + 1) * TICK
    return rows.select(
        F.format_string("SYM%06d", "id").alias("symbol"),
        "n",
        F.when(F.col("n") == 1, "snapshot").otherwise("delta").alias("kind"),
        F.col("n").alias("first_id"),
        F.col("n").alias("final_id"),
        (F.col("n") - 1).alias("prev_id"),
        side.alias("side"),
        F.when(draw("side", 2) == 0, F.lit(MID) - away).otherwise(F.lit(MID) + away).alias("price"),
        F.when(draw("zero", zeros_in) == 0, 0).otherwise(draw("qty", MOST_QTY) + 1).alias("qty"),
    )
