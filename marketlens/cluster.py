"""Make the library importable in Spark's Python workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share; only a session that has none and runs in one
    process gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_marketlens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="marketlens-")  # the driver serves the archive from here while the application lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "marketlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for here, _, files in os.walk(_ROOT):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(here, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_ROOT)))
    context.addPyFile(archive)
    context._marketlens_shipped = True
