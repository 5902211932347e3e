"""Intermediate tables in the shared checkpoint folder.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the one folder that the driver and every executor share, so a lost
executor costs a re-read and not a recomputation. Only where that setting is absent and Spark runs inside one process (tests) is a
temporary folder used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; set here only if the session has none and runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables written so far
_written: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _delete(table.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession):
    """Within it, tables of ``materialize`` are deleted at the end, but for the ones put into the list that it gives."""
    start, kept = len(_written), []
    yield kept
    keep = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for table in kept for f in table.inputFiles()}
    for folder in _written[start:]:
        if folder.rsplit("/", 1)[-1] not in keep:
            _delete(spark, folder)
    _written[start:] = [f for f in _written[start:] if f.rsplit("/", 1)[-1] in keep]


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only when the table has at most ``limit`` rows; beyond that the join is left to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: A key of more rows than this is joined apart from the others
HOT_KEY = 1_000


def join_by_count(rows: DataFrame, table: DataFrame, on: str | list[str], n: str, limit: int) -> DataFrame:
    """``rows`` joined with the unique keys of ``table``, whose column ``n`` says how many rows have each key; the column goes.

    Keys of many rows are few, at most one in HOT_KEY of all rows; they are broadcast where their count allows, so their rows stay where
    they are and only the others are shuffled. Both tables are read twice and should be written ones.
    """
    hot = materialize(table.where(F.col(n) > HOT_KEY).drop(n), "hot-keys")
    found = hot.limit(limit + 1).count()
    if not 0 < found <= limit:
        discard(hot)
        return rows.join(table.drop(n), on)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(table.where(F.col(n) <= HOT_KEY).drop(n), on))


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts are long rows, and a batch is held by the JVM and Python
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Set smaller Arrow batches for the session, unless its owner has set their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(docs: DataFrame, run, schema: str, id_: str = "doc_id", *more: str) -> DataFrame:
    """``mapInPandas`` over an id, ``more`` and no other columns. The id passes as a string, since pandas has no null integers, and gets
    its type back afterwards; ``run`` sees and returns it under its own name, and ``schema`` is that of the columns after it."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_].dataType
    out = docs.select(F.col(id_).cast("string").alias(id_), *more).mapInPandas(run, f"{id_} string, {schema}")
    return out.withColumn(id_, F.col(id_).cast(kind))


def filter_texts(docs: DataFrame, decide) -> DataFrame:
    """The rows, all columns, whose text ``decide()`` keeps: it is called once a task and gives a function from texts to booleans."""
    def run(batches):
        keep = None
        for batch in batches:
            keep = keep or decide()
            yield batch.filter(pa.array([bool(x) for x in keep(batch.column("text").to_pylist())], pa.bool_()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """At most ``limit`` rows: those whose count lies above a bar, which is set where the rows above it come nearest to the limit.

    The bar is found from a histogram of some thousand steps of about one percent, so no partition sends more than it keeps.
    """
    step = F.floor(F.log2(F.col(n)) * 64)
    steps = sorted(((r["_step"], r["_rows"]) for r in counts.where(F.col(n) > 0).groupBy(step.alias("_step")).agg(F.count(F.lit(1)).alias("_rows")).collect()), reverse=True)
    bar, kept = None, 0
    for at, rows in steps:
        if kept + rows > limit:
            break
        bar, kept = at, kept + rows
    return counts.where((F.col(n) > 0) & (step >= bar)) if bar is not None else counts.limit(0)
