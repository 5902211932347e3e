"""Event time in arrival order: which rows come later than the watermark allows, and what silence alone makes happen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Batches whose watermarks are found together; only one row for each so many batches meets in one task
BLOCK = 1_024


def running_max(values: DataFrame, number: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``values`` (one row a number, none missing is needed) with the largest ``value`` of all smaller numbers; null for the first.

    Blocks of numbers are summed up first, so the window over all holds one row a block, and another one the rows of one block.
    """
    held = values.withColumn("_block", F.floor(F.col(number) / block))
    tops = held.groupBy("_block").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_block", F.max("_top").over(before).alias("_earlier"))
    inside = Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("_near", F.max(value).over(inside)).join(tops, "_block").withColumn(name, F.greatest("_near", "_earlier")).drop("_block", "_near", "_earlier")


def judge(rows: DataFrame, order: list[str], range_: Column, time: str, size: int, allowance: int) -> DataFrame:
    """Rows with ``batch``, ``watermark`` and ``late``: in the given total order of arrival they come in batches of ``size``; a batch's
    watermark is the largest time of all batches before it less the allowance, and rows below it are late. In the first batch none is.
    ``range_`` does not fall as the order rises (see ``numbering.numbered``)."""
    dealt = numbered(rows, [], order, range_).withColumn("batch", F.floor(F.col("number") / size)).drop("number")
    tops = dealt.groupBy("batch").agg(F.max(time).alias("_time"))
    marks = running_max(tops, "batch", "_time", "_mark").select("batch", (F.col("_mark") - allowance).alias("watermark"))
    return dealt.join(marks, "batch").withColumn("late", F.coalesce(F.col(time) < F.col("watermark"), F.lit(False)))


def silent(events: DataFrame, key: str, time: str, opens: Column, answers: Column, timeout: int) -> DataFrame:
    """Keys that silence alone makes unknown, and when: no answer comes within ``timeout`` after the opening event, and the time of the
    whole input passes that limit. One aggregate by key; the end of the input's time is one number."""
    asked = events.groupBy(key).agg(F.min(F.when(opens, F.col(time))).alias("_opened"), F.min(F.when(answers, F.col(time))).alias("_answered"), F.max(time).alias("_last"))
    now = asked.agg(F.max("_last")).first()[0]
    due = F.col("_opened") + timeout
    return asked.where(F.col("_opened").isNotNull() & (F.col("_answered").isNull() | (F.col("_answered") > due)) & (due < (F.lit(now).cast("long")))).select(key, due.alias("unknown_at"))
