"""Recorded frames as a Spark data source, for batch and streams: what an exchange's sockets and endpoints would deliver.

``spark.read.format("recorded_frames").option("path", folder)`` reads files (``suffix``, .jsonl) of JSON lines {captured_at_ns, source_kind, payload}, one file
a shard. Files are cut into ranges of ``splitBytes``; a line belongs to the range that it begins in. As a stream, the offset is a position
in each shard: a trigger takes whole lines of up to ``bytesPerBatch`` of every shard, and shards may grow and new ones appear while it runs. A
live socket reader would implement the same class; this environment has no network.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import files

SCHEMA = "shard string, position long, captured_at_ns long, source_kind string, payload string"
KINDS = ("raw_ws", "normalized", "archive")
#: Bytes of a file that are read at a time
BLOCK = 1 << 20


def _lines(folder: str, shard: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin at ``start`` or later and before ``end``; a last line without its end is complete only
    where the file is read to its end."""
    system, at = files.opened(f"{folder}/{shard}")
    with system.open_input_file(at) as source:
        source.seek(max(0, start - 1))
        at, held = max(0, start - 1), b""
        skip = start > 0  # up to the end of the line before
        while at < end or held:
            block = source.read(BLOCK)
            held += block
            while (cut := held.find(b"\n")) >= 0 or (not block and held):
                line, held = (held[:cut], held[cut + 1 :]) if cut >= 0 else (held, b"")
                size = len(line) + (cut >= 0)
                if skip:
                    skip = False
                elif at >= end:
                    return
                else:
                    yield at, line
                at += size
            if not block:
                return


def _rows(partition: _Range) -> Iterator[tuple]:
    for at, line in _lines(partition.folder, partition.shard, partition.start, partition.end):
        if line.strip():
            row = json.loads(line)
            yield partition.shard, at, int(row["captured_at_ns"]), str(row["source_kind"]), str(row["payload"])


class _Range(InputPartition):
    def __init__(self, folder: str, shard: str, start: int, end: int):
        self.folder, self.shard, self.start, self.end = folder, shard, start, end


def _ranges(folder: str, start: dict[str, int], end: dict[str, int], split: int) -> list[_Range]:
    return [_Range(folder, shard, at, min(at + split, stop)) for shard, stop in end.items() for at in range(start.get(shard, 0), stop, split)]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str, split: int):
        self.folder, self.suffix, self.split = folder, suffix, split

    def partitions(self):
        return _ranges(self.folder, {}, files.sizes(self.folder, self.suffix), self.split)

    def read(self, partition):
        yield from _rows(partition)


class _StreamReader(DataSourceStreamReader):
    """``upto`` is how far triggers have been planned. Spark asks for the initial offset of a new query only, and does not tell a restarted
    one its last offset before it asks for the next; then the first trigger takes all there is, which is never less than what was read."""

    def __init__(self, folder: str, suffix: str, step: int, split: int):
        self.folder, self.suffix, self.step, self.split = folder, suffix, step, split
        self.upto: dict[str, int] | None = None

    def initialOffset(self):
        self.upto = {}
        return {}

    def _newline(self, shard: str, at: int, size: int, last: bool) -> int:
        """The position after the last line end between ``at`` and ``size``, or after the first one; ``at`` if there is none."""
        system, path = files.opened(f"{self.folder}/{shard}")
        with system.open_input_file(path) as source:
            places = range(at, size, BLOCK)
            for place in reversed(places) if last else places:
                source.seek(place)
                block = source.read(min(BLOCK, size - place))
                found = block.rfind(b"\n") if last else block.find(b"\n")
                if found >= 0:
                    return place + found + 1
        return at

    def latestOffset(self):
        ends = {}
        for shard, size in files.sizes(self.folder, self.suffix).items():
            at = (self.upto or {}).get(shard, 0)
            stop = size if self.upto is None else min(size, at + self.step)
            end = self._newline(shard, at, stop, last=True)
            ends[shard] = end if end > at else self._newline(shard, stop, size, last=False) if stop < size else at
            if ends[shard] == stop < size and end == at:
                ends[shard] = at  # a line that is longer than a step and not whole yet
        self.upto = ends
        return ends

    def partitions(self, start, end):
        before = self.upto or {}
        self.upto = {shard: max(before.get(shard, 0), end.get(shard, 0)) for shard in {**before, **end}}
        return _ranges(self.folder, start, end, self.split)

    def read(self, partition):
        yield from _rows(partition)

    def commit(self, end):
        pass


class RecordedFrames(DataSource):
    @classmethod
    def name(cls):
        return "recorded_frames"

    def schema(self):
        return SCHEMA

    def _where(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("suffix", ".jsonl")

    def _split(self) -> int:
        return int(self.options.get("splitBytes", str(64 << 20)))

    def reader(self, schema):
        return _Reader(*self._where(), self._split())

    def streamReader(self, schema):
        return _StreamReader(*self._where(), int(self.options.get("bytesPerBatch", str(16 << 20))), self._split())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedFrames)
