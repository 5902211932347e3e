"""Row numbers over long orders in two passes: counts of ranges first, then numbers inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: list[str], range_: Column) -> DataFrame:
    """Rows with ``number``, from 0 within ``keys`` in the given order, which must be total.

    ``range_`` must not fall as the order rises, nulls first. Its values' counts are summed up in one window, of one row per key and value; rows
    are numbered inside a range only, so no task holds a whole key.
    """
    ranged = rows.withColumn("_range", range_)
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = F.col("_range").eqNullSafe(F.col("_of"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranged.join(starts, on).withColumn("number", (F.col("_start") + inside).cast("long")).drop("_range", "_of", "_start", *[f"_key_{k}" for k in keys])
