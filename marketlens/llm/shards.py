"""Sorted arrays of integers as files in the shared folder, and lookups in them by binary search in memory-mapped files."""

from __future__ import annotations

import re

import numpy as np
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import SparkSession


def _local(path: str) -> str | None:
    """The path if the shared folder is mounted; Spark writes such paths as ``file:/x``."""
    path = re.sub(r"^file:/+", "/", path)
    return path if path.startswith("/") else None


class Writer:
    """A shard: a file of keys and one of values."""

    def __init__(self, path: str):
        self.path = path
        system, name = (pyarrow.fs.LocalFileSystem(), _local(path)) if _local(path) else pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.files = [system.open_output_stream(f"{name}-{part}") for part in ("keys", "values")]

    def put(self, *columns: np.ndarray) -> None:
        for file, column in zip(self.files, columns, strict=True):
            file.write(column.astype("<i8").tobytes())

    def close(self) -> str:
        for file in self.files:
            file.close()
        return self.path


def offer(spark: SparkSession, paths: list[str]) -> None:
    """Have executors fetch shards from a store that is not mounted, once each, into folders that Spark keeps for them."""
    for path in paths:
        if not _local(path):
            for part in ("keys", "values"):
                spark.sparkContext.addFile(f"{path}-{part}")


def _mapped(path: str, part: str) -> np.ndarray:
    return np.memmap(f"{_local(path) or SparkFiles.get(path.rsplit('/', 1)[-1])}-{part}", "<i8", "r")


class Table:
    """Values by key over shards given as (first key, path), in order and without common keys. A shard is opened when first needed."""

    def __init__(self, parts: list[tuple[int, str]]):
        self.paths = [path for _, path in parts]
        self.first = np.array([first for first, _ in parts], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of sorted keys; 0 for those of no shard."""
        out = np.zeros(len(keys), np.int64)
        edges = [*np.searchsorted(keys, self.first).tolist(), len(keys)]
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo == hi:
                continue
            if i not in self.open:
                self.open[i] = _mapped(self.paths[i], "keys"), _mapped(self.paths[i], "values")
            held, values = self.open[i]
            at = np.searchsorted(held, keys[lo:hi])
            at[at == len(held)] = 0
            out[lo:hi] = np.where(held[at] == keys[lo:hi], values[at], 0)
        return out
