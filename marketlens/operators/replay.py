"""Replay of recorded frames: timing and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from . import folds


def emit_times(frames: DataFrame, start_ns: int, num: int = 1, den: int = 1) -> DataFrame:
    """Frames with the time at which each is due: the recorded offset from the first, times num / den (larger is slower)."""
    first = frames.agg(F.min("captured_at_ns")).first()[0] or 0  # one number
    offset = (F.col("captured_at_ns") - F.lit(first).cast("long")) * num
    return frames.withColumn("emit_at_ns", F.lit(start_ns).cast("long") + div(offset, F.lit(max(1, den))))


def inject(frames: DataFrame, drop: int, corrupt: int, duplicate: int, seed: int, key: str = "recording") -> DataFrame:
    """Frames as a faulty replay delivers them. The generator runs through a recording in order, so each recording is one stream."""
    marked = folds.run(frames.withColumn("size", F.octet_length("payload").cast("long")), folds.faults(drop, corrupt, duplicate, seed), key, ["captured_at_ns", "frame_id"])
    sent = marked.where(F.col("copies") > 0).withColumn("is_duplicate", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda i: i > 1)))
    at = (F.col("flipped_at") + 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("payload"), at, F.lit(1))), 16, 10).cast("int")
    flipped = F.unhex(F.lpad(F.hex((255 - byte).cast("long")), 2, "0"))
    spoilt = F.concat(F.substring(F.col("payload"), F.lit(1), at - 1), flipped, F.substring(F.col("payload"), at + 1, F.octet_length("payload")))
    return sent.withColumn("was_corrupted", F.col("flipped_at").isNotNull()).withColumn("payload", F.when(F.col("flipped_at").isNotNull(), spoilt).otherwise(F.col("payload")))


def statistics(delivered: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: delivered, dropped, corrupted and duplicated."""
    first = ~F.col("is_duplicate")
    sums = delivered.agg(F.count_if(first).alias("delivered"), F.count_if(first & F.col("was_corrupted")).alias("corrupted"), F.count_if(F.col("is_duplicate")).alias("duplicated"))
    return sums.select("delivered", (F.lit(recorded.count()) - F.col("delivered")).alias("dropped"), "corrupted", "duplicated")
