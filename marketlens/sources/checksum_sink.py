"""A sink of book checksums with a commit protocol, and its reader: ``format("book_checksums")``, for batch and streams.

Each task offers its rows as binary messages to a file of its own and answers with the file's name and what became of the rows; the
driver then puts one commit into the folder, which names the files of all tasks. Readers look at files of commits only, so rows of tasks
that failed or ran twice are never seen. A stream's commits bear their batch's number, and a batch that is committed is not again.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from . import binary, files

#: The message's fields, the checksum in 16 hex digits, and the message's place in its file; rows to write have all but that
FIELDS = ("symbol", "update_id", "bid_depth", "ask_depth", "checksum")
SCHEMA = "symbol string, update_id long, bid_depth long, ask_depth long, checksum string, position long"
#: Type of a checksum's message; the longest symbol that its length field can tell; the field before each message in a file
MESSAGE_TYPE, LONGEST_SYMBOL = 18, 65_535
_LENGTH = struct.Struct("<I")
COMMITS = "_commits"


@dataclass
class Written(WriterCommitMessage):
    """A task's answer: its file and how many rows met each result."""

    file: str
    results: dict


def offer(row) -> tuple[str, bytes]:
    """Ok and the message; or Closed and nothing for a row that cannot be one, without a value or with a symbol that is too long."""
    values = row.asDict()
    if None in values.values() or len(values["symbol"].encode()) > LONGEST_SYMBOL:
        return "Closed", b""
    head = {name: 0 for name, _ in binary.HEADER} | {"message_type": MESSAGE_TYPE}
    return "Ok", binary.encode_message(head | values | {"checksum": int(values["checksum"], 16)})


def _put(system: pyarrow.fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file that appears whole."""
    hidden = "/.".join(path.rsplit("/", 1)) + uuid.uuid4().hex
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, path)


class _Work:
    """What writers of batches and of streams share: a task's file, a commit, and the deletion of files of a write that failed."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        system, at = files.opened(self.folder)
        system.create_dir(at, recursive=True)
        name, results = f"{uuid.uuid4().hex}.bin", Counter()
        with system.open_output_stream(f"{at}/{name}") as out:
            for row in iterator:
                result, message = offer(row)
                results[result] += 1
                out.write(_LENGTH.pack(len(message)) + message if message else b"")
        return Written(name, dict(results))

    def _commit(self, name: str, messages: list) -> None:
        system, at = files.opened(self.folder)
        system.create_dir(f"{at}/{COMMITS}", recursive=True)
        done = [m for m in messages if m is not None]
        total = sum((Counter(m.results) for m in done), Counter())
        _put(system, f"{at}/{COMMITS}/{name}.json", json.dumps({"files": [m.file for m in done], "results": total}).encode())

    def _abort(self, messages: list) -> None:
        system, at = files.opened(self.folder)
        for m in messages:
            if m is not None:
                system.delete_file(f"{at}/{m.file}")


class _Writer(_Work, DataSourceWriter):
    def commit(self, messages):
        self._commit(uuid.uuid4().hex, messages)

    def abort(self, messages):
        self._abort(messages)


class _StreamWriter(_Work, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        if f"batch-{batchId}.json" in files.sizes(f"{self.folder}/{COMMITS}", ".json"):
            self._abort(messages)  # written again after a failure between this commit and Spark's own
        else:
            self._commit(f"batch-{batchId}", messages)

    def abort(self, messages, batchId):
        self._abort(messages)


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


def commits(folder: str) -> list[dict]:
    """All commits of a folder: files and how many rows met each result."""
    found = []
    for name in files.sizes(f"{folder}/{COMMITS}", ".json"):
        system, at = files.opened(f"{folder}/{COMMITS}/{name}")
        with system.open_input_stream(at) as source:
            found.append(json.loads(source.read()))
    return found


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [_File(f) for entry in commits(self.folder) for f in entry["files"]] or [_File("")]

    def read(self, partition):
        if not partition.name:
            return
        system, at = files.opened(f"{self.folder}/{partition.name}")
        with system.open_input_stream(at) as source:
            position = 0
            while head := source.read(_LENGTH.size):
                (size,) = _LENGTH.unpack(head)
                row = binary.decode_message(source.read(size), MESSAGE_TYPE)
                yield row["symbol"], row["update_id"], row["bid_depth"], row["ask_depth"], f"{int(row['checksum']):016x}", position
                position += _LENGTH.size + size


class BookChecksums(DataSource):
    @classmethod
    def name(cls):
        return "book_checksums"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("commits are only added: use mode append")
        return _Writer(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BookChecksums)
