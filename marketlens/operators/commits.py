"""Commits of a buffered sink: a batch ends when it has so many rows, or so long after its first one, whichever comes first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000_000
MAX_ROWS, PERIOD = 10_000, SECOND


def cut(times: np.ndarray, period: int, max_rows: int, started: int | None = None, held: int = 0) -> tuple[np.ndarray, int | None, int]:
    """How many commits come before each of the sorted times, given an open batch's first time and rows; and the batch open at the end.
    One step a batch, not a row."""
    number, i, commits = np.zeros(len(times), np.int64), 0, 0
    while i < len(times):
        if started is not None and (held >= max_rows or times[i] >= started + period):
            commits, started, held = commits + 1, None, 0
        started = int(times[i]) if started is None else started
        end = min(i + max_rows - held, int(np.searchsorted(times, started + period, "left")))
        number[i:end] = commits
        i, held = end, held + end - i
    return number, started, held


def pauses(rows: DataFrame, key: str, time: str, period: int, width: int = 64) -> DataFrame:
    """Rows with ``_stretch``, which rises after each pause of a key that is known to be as long as a period: no batch spans one. Pauses
    are looked for between cells of ``width`` periods, so the window over a key holds a row a cell."""
    cell = F.floor(F.col(time) / (width * period))
    cells = rows.groupBy(key, cell.alias("_cell")).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    by = Window.partitionBy(key).orderBy("_cell")
    new = F.coalesce(F.col("_first") - F.lag("_last").over(by) >= period, F.lit(True))
    cells = cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_of"), F.sum(new.cast("long")).over(by).alias("_stretch"))
    return rows.withColumn("_cell", cell).join(cells, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_of"))).drop("_cell", "_key", "_of")


def numbered(rows: DataFrame, key: str, time: str, tie: str, max_rows: int = MAX_ROWS, period: int = PERIOD) -> DataFrame:
    """Rows with ``commit``, the number of the commit within their key that takes them, from 0.

    A key's batches follow from one another, but none spans a pause of a period. So keys are split at pauses into stretches, which are
    passes of their own over sorted rows; their commits are counted and added up. A key without a pause is one task's pass.
    """
    stretched = pauses(rows, key, time, period)
    at = {c: stretched.columns.index(c) for c in (key, time, "_stretch")}

    def run(batches):
        last, started, held, done = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, stretches, times = (batch.column(at[c]) for c in (key, "_stretch", time))
            times, stretches = times.to_numpy(), stretches.to_numpy()
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((codes[1:] != codes[:-1]) | (stretches[1:] != stretches[:-1])) + 1
            out = np.empty(batch.num_rows, np.int64)
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                name = (keys[lo].as_py(), int(stretches[lo]))
                if name != last:
                    last, started, held, done = name, None, 0, 0
                number, started, held = cut(times[lo:hi], period, max_rows, started, held)
                out[lo:hi] = done + number
                done = int(out[hi - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "_commit"])

    ordered = stretched.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", time, tie)
    local = ordered.mapInArrow(run, T.StructType([*stretched.schema.fields, T.StructField("_commit", T.LongType())]))
    counts = local.groupBy(key, "_stretch").agg((F.max("_commit") + 1).alias("_n"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = local.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_of")))
    return joined.withColumn("commit", F.col("_start") + F.col("_commit")).drop("_stretch", "_commit", "_key", "_of", "_start")
