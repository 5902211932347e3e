"""Micro-batches as whole epochs over several tables: rows are written first, then one entry of a log makes all of them visible.

The log belongs to one checkpoint, whose batch numbers are the epochs. An epoch in the log is done: running it again does nothing. One
that failed midway left folders that no reader looks at, and that are written anew. Files are moved and listed through Hadoop's file
systems, by the driver only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits, landing

LOG = "_epochs"


class EpochLog:
    """Entries of finished epochs below ``folder``, each a small JSON text. An entry appears at once, by a rename."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, epoch: int):
        return self._path(f"{self.folder}/{LOG}/{epoch}.json")

    def has(self, epoch: int) -> bool:
        return self._files.exists(self._at(epoch))

    def entry(self, epoch: int) -> dict | None:
        if not self.has(epoch):
            return None
        stream = self._files.open(self._at(epoch))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self) -> int:
        """The last finished epoch, -1 before the first. Epochs finish in order."""
        at = self._path(f"{self.folder}/{LOG}")
        if not self._files.exists(at):
            return -1
        return max((int(name[:-5]) for s in self._files.listStatus(at) if (name := s.getPath().getName()).endswith(".json") and name[:-5].isdigit()), default=-1)

    def finish(self, epoch: int, **entry) -> None:
        started = self._path(f"{self.folder}/{LOG}/.{epoch}.started")
        stream = self._files.create(started, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        if not self._files.rename(started, self._at(epoch)) and not self.has(epoch):
            raise OSError(f"epoch {epoch} cannot be put into the log below {self.folder}")


def write_epoch(log: EpochLog, epoch: int, tables: dict[str, DataFrame], **entry) -> bool:
    """Write one epoch's rows of all tables and finish it; False, with nothing done, if it is finished already."""
    if log.has(epoch):
        return False
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{log.folder}/{table}/epoch={epoch}")
    log.finish(epoch, **entry)
    return True


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's rows of finished epochs, with ``epoch``. Epochs finished later are not in it, however long it is read."""
    newest = EpochLog(spark, folder).newest()
    return spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}").where(F.col("epoch") <= newest)


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None):
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def split_late(stream: DataFrame, time: str, allowance: int, folder: str, checkpoint: str, every: str | None = None):
    """Start a query that writes rows on time to the table ``on_time`` and late ones to ``late``, with ``watermark``: the largest
    ``time`` of all epochs before less the allowance, as ``lateness.judge`` has it. The log keeps the largest time so far."""
    log = EpochLog(stream.sparkSession, folder)

    def write(batch: DataFrame, epoch: int) -> None:
        if log.has(epoch):
            return
        before = log.entry(epoch - 1) if epoch else None
        top = before["top"] if before else None
        kept = batch.persist()
        try:
            newest = kept.agg(F.max(time)).first()[0]
            mark = F.lit(None if top is None else top - allowance).cast("long")
            judged = kept.withColumn("watermark", mark)
            late = F.coalesce(F.col(time) < mark, F.lit(False))
            write_epoch(log, epoch, {"on_time": judged.where(~late), "late": judged.where(late)}, top=max((x for x in (top, newest) if x is not None), default=None))
        finally:
            kept.unpersist()

    return _started(stream, write, checkpoint, every)


def land(messages: DataFrame, time: str, tie: str, folder: str, checkpoint: str, every: str | None = None, max_rows: int = commits.MAX_ROWS, period: int = commits.PERIOD):
    """Start a query that puts each micro-batch's rows into the tables of their message types, all at once, with ``commit``: within an
    epoch, rows of a table with one number are what the sink's two limits would have it insert together (see ``commits``)."""
    log = EpochLog(messages.sparkSession, folder)
    names = F.create_map(*[F.lit(x) for pair in landing.TABLES.items() for x in pair])

    def write(batch: DataFrame, epoch: int) -> None:
        if log.has(epoch):
            return
        named = batch.withColumn("_table", names[F.col("message_type")]).where(F.col("_table").isNotNull())
        kept = commits.numbered(named, "_table", time, tie, max_rows, period).persist()
        try:
            write_epoch(log, epoch, {table: kept.where(F.col("_table") == table).drop("_table") for table in landing.TABLES.values()})
        finally:
            kept.unpersist()

    return _started(messages, write, checkpoint, every)
