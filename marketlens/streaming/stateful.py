"""Streaming twins: the same folds over stored state, windows with watermarks, deduplication, and routing to tables.

State is kept by ``applyInPandasWithState``, one entry per key, so a query started again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import landing
from ..operators.folds import Fold

TABLE_PATHS = landing.TABLES


def _plain(value):
    """A stored value as the fold's step expects it: nested arrays become tuples."""
    return tuple(_plain(x) for x in value) if isinstance(value, (list, tuple, T.Row)) else value


def _stored(value):
    """A value of the fold's state as the state store takes it: sets and maps become arrays."""
    return sorted(value) if isinstance(value, (set, frozenset)) else list(value.items()) if isinstance(value, dict) else value


def run(stream: DataFrame, fold: Fold, key: str, order: list[str]) -> DataFrame:
    """The fold's columns for each row of the stream, in append mode.

    Rows of a trigger are taken in the given order within a key; order across triggers is that of arrival. Folds whose state is a
    growing set keep it in the state, bounded by what a key can hold.
    """
    added = T.StructType.fromDDL(fold.adds)
    names = [f.name for f in added.fields]
    out_schema = T.StructType([*stream.schema.fields, *added.fields])
    start, step, reads = fold.start, fold.step, fold.reads
    sets = tuple(isinstance(x, frozenset) for x in start)

    def advance(group_key, batches, state: GroupState):
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        rows = rows.astype({c: object for c in rows.columns if isinstance(rows[c].dtype, pd.StringDtype)})  # one chunk a column
        now = tuple(frozenset(x) if is_set else _plain(x) for x, is_set in zip(state.get, sets, strict=True)) if state.exists else start
        out = []
        for values in zip(*(rows[c] for c in reads), strict=True):
            now, row = step(now, *values)
            out.append(row)
        state.update(tuple(map(_stored, now)))
        columns = zip(*out, strict=True)
        yield rows.assign(**{n: pd.array(list(c), "Int64") if isinstance(f.dataType, T.LongType) else list(c) for n, c, f in zip(names, columns, added.fields, strict=True)})

    return stream.groupBy(key).applyInPandasWithState(advance, out_schema, fold.state, "append", GroupStateTimeout.NoTimeout)


def rates(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Messages by tumbling window; windows close once the watermark passes them, and later rows are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Episodes of a key: rows no further apart than the gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def first_sightings(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats arrive within the watermark; the state of older keys is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def land_by_type(messages: DataFrame, folder: str, checkpoint: str, every: str | None = None):
    """Start a query that appends each micro-batch's rows to the tables of their message types. A batch that is run again after a
    failure replaces what it wrote, as every batch has a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for code, table in TABLE_PATHS.items():
            rows = kept.where(F.col("message_type") == code)
            rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")
        kept.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
