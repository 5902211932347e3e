"""Counters, latency histograms and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Inclusive upper bounds of the latency buckets, in ns
BOUNDS = (
    1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000, 25_000_000, 50_000_000,
    100_000_000, 200_000_000, 500_000_000, 1_000_000_000, 5_000_000_000,
)
OVERFLOW = (1 << 63) - 1


def bucket(value: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """The smallest bound that is not below the value, or ``OVERFLOW``."""
    out = F.lit(OVERFLOW)
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(b).cast("long")).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, keys: list[str], bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Counts and sums by bucket, every bucket present, with cumulative counts; negative values are left out."""
    counted = df.where(F.col(value) >= 0).groupBy(*keys, bucket(F.col(value), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    every = counted.select(*keys).distinct().withColumn("le", F.explode(F.array(*[F.lit(b).cast("long") for b in (*bounds, OVERFLOW)])))
    dense = every.join(counted, [*keys, "le"], "left").fillna(0, ["n", "total"])
    so_far = Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("cumulative", F.sum("n").over(so_far))


def bucket_percentiles(hist: DataFrame, keys: list[str], percents: list[float]) -> DataFrame:
    """For each percentile the upper bound of the first bucket that reaches its rank, ``OVERFLOW`` beyond the last bound."""
    size = F.max("cumulative").over(Window.partitionBy(*keys))
    ranks = hist.withColumn("size", size).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    reached = ranks.where(F.col("cumulative") >= F.ceil(F.col("size") * F.col("p") / 100.0))
    return reached.groupBy(*keys, "p").agg(F.min("le").alias("bound"))


def nearest_rank(df: DataFrame, value: str, keys: list[str], percents: dict[str, float]) -> DataFrame:
    """Exact percentiles by nearest rank of the positive values, with count and maximum."""
    exact = [F.expr(f"percentile_disc({p}) within group (order by {value})").cast(df.schema[value].dataType).alias(name) for name, p in percents.items()]
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *exact, F.max(value).alias("largest"))


def rates(df: DataFrame, time_ns: str, keys: list[str], seconds: int) -> DataFrame:
    """Messages and messages a second in each tumbling interval."""
    span = seconds * 1_000_000_000
    start = (F.col(time_ns) - F.pmod(F.col(time_ns), F.lit(span))).alias("start_ns")
    return df.groupBy(*keys, start).agg(F.count(F.lit(1)).alias("n")).withColumn("per_second", F.col("n") / float(seconds))


def prometheus_text(hist: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(line) of the text exposition of histograms: cumulative buckets, sum and count."""
    labels = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), F.col(k).cast("string"), F.lit('"')) for k in keys])
    le = F.when(F.col("le") == OVERFLOW, "+Inf").otherwise(F.col("le").cast("string"))
    rows = hist.select(*keys, F.concat(F.lit(f"{name}_bucket{{"), labels, F.lit(',le="'), le, F.lit('"} '), F.col("cumulative").cast("string")).alias("line"))
    ends = hist.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    ends = ends.select(*keys, F.explode(F.array(F.concat(F.lit(f"{name}_sum{{"), labels, F.lit("} "), F.col("total").cast("string")), F.concat(F.lit(f"{name}_count{{"), labels, F.lit("} "), F.col("n").cast("string")))).alias("line"))
    return rows.unionByName(ends).select("line")
