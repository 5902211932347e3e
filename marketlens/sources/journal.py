"""The order journal: append-only files of records (tag, time, length, payload), read and written as rows, a batch of a tag at a time.

A journal is written as segments of a bounded number of records; a file is one task's work, as it has no marks to split at.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import files, packed

# Record tags and their payload's fields; "b" is a text with an 8-bit length, "s" one with a 16-bit length
RECORDS = {
    1: ("OrderRequested", [("cloid", "b"), ("symbol", "b"), ("side", "B"), ("order_type", "B"), ("time_in_force", "B"), ("qty", "q"), ("limit_price", "?q")]),
    2: ("OrderAcknowledged", [("cloid", "b"), ("exchange_id", "Q")]),
    3: ("OrderFilled", [("cloid", "b"), ("qty", "q"), ("price", "q"), ("is_final", "?")]),
    4: ("OrderCancelled", [("cloid", "b")]),
    5: ("OrderRejected", [("cloid", "b"), ("reason", "s")]),
    6: ("OrderExpired", [("cloid", "b")]),
}
COLUMNS = "tag long, timestamp_ns long, cloid string, symbol string, side long, order_type long, time_in_force long, qty long, limit_price long, exchange_id long, price long, is_final boolean, reason string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _put(code: str, value) -> bytes:
    if code in "bs":
        raw = value.encode()
        return struct.pack("<B" if code == "b" else "<H", len(raw)) + raw
    if code == "?q":
        return b"\x00" if pd.isna(value) else b"\x01" + struct.pack("<q", int(value))
    return struct.pack("<" + code, value if code == "?" else int(value))


def _get(code: str, data: bytes, at: int):
    if code in "bs":
        n, at = (data[at], at + 1) if code == "b" else (struct.unpack_from("<H", data, at)[0], at + 2)
        return data[at : at + n].decode(), at + n
    if code == "?q":
        return (None, at + 1) if data[at] == 0 else (struct.unpack_from("<q", data, at + 1)[0], at + 9)
    size = struct.calcsize("<" + code)
    return struct.unpack_from("<" + code, data, at)[0], at + size


def encode(row: dict) -> bytes:
    payload = b"".join(_put(code, row[name]) for name, code in RECORDS[int(row["tag"])][1])
    return struct.pack("<BqH", int(row["tag"]), int(row["timestamp_ns"]), len(payload)) + payload


def decode(data: bytes) -> Iterator[dict]:
    """The file's records in order. A record cut off at the end, as a crash leaves it, ends the file; an unknown tag is an error."""
    at = 0
    while at + 11 <= len(data):
        tag, time, size = struct.unpack_from("<BqH", data, at)
        if at + 11 + size > len(data):
            return
        row, place = {"tag": tag, "timestamp_ns": time}, at + 11
        for name, code in RECORDS[tag][1]:
            row[name], place = _get(code, data, place)
        yield row
        at += 11 + size


#: Records of a segment, and of a batch that is read at a time
SEGMENT, BATCH = 1_000_000, 100_000
_HEAD = np.dtype([("tag", "u1"), ("timestamp_ns", "<i8"), ("size", "<u2")])
_KINDS = {"B": "u1", "?": "u1", "q": "<i8", "Q": "<i8"}
_TEXT = {"b": "u1", "s": "<u2"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_TYPES = [(n, _ARROW[t]) for n, t in (c.split() for c in COLUMNS.split(", "))]


def _encoded(batch: pa.RecordBatch) -> pa.Array:
    """(record) of each row: rows are packed tag by tag and put back into their order."""
    tags, made, places = np.asarray(batch.column("tag")), [], []
    for tag in np.unique(tags).tolist():
        at = np.flatnonzero(tags == tag)
        rows = batch.take(pa.array(at))
        parts = []
        for name, code in RECORDS[tag][1]:
            column = rows.column(name)
            if code in _TEXT:
                parts.append(packed.texts(column, _TEXT[code]))
            else:
                parts.append(packed.optional(column) if code == "?q" else packed.numbers({name: column}, np.dtype([(name, _KINDS[code])])))
        payload = packed.pack(parts)
        head = np.zeros(len(at), _HEAD)
        head["tag"], head["timestamp_ns"], head["size"] = tag, np.asarray(rows.column("timestamp_ns")), np.diff(packed.bytes_of(payload)[0])
        offsets, data = packed.bytes_of(payload)
        made.append(packed.pack([(head.view(np.uint8).reshape(len(at), _HEAD.itemsize), None, None), (np.zeros((len(at), 0), np.uint8), np.diff(offsets), data)]))
        places.append(at)
    if not made:
        return pa.array([], pa.binary())
    return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(places))))


def _places(data: np.ndarray) -> np.ndarray:
    """Where each whole record begins; one that is cut off at the end, as a crash leaves it, ends the file."""
    low, high, at, found, n = data[9:].tobytes(), data[10:].tobytes(), 0, [], len(data)
    while at + _HEAD.itemsize <= n:
        after = at + _HEAD.itemsize + (low[at] | high[at] << 8)
        if after > n:
            break
        found.append(at)
        at = after
    return np.array(found, np.int64)


def _decoded(data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The records at some places, in order."""
    head = np.ascontiguousarray(data[at[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).reshape(-1)
    unknown = set(np.unique(head["tag"]).tolist()) - set(RECORDS)
    if unknown:
        raise ValueError(f"unknown record tags {sorted(unknown)}")
    tables, order = [], []
    for tag in np.unique(head["tag"]).tolist():
        own = np.flatnonzero(head["tag"] == tag)
        start = at[own] + _HEAD.itemsize
        cursor = packed.Cursor(data, start, start + head["size"][own])
        for name, code in RECORDS[tag][1]:
            if code in _TEXT:
                cursor.text(name, _TEXT[code])
            elif code == "?q":
                cursor.optional(name)
            else:
                cursor.numbers(np.dtype([(name, _KINDS[code])]))
        found = cursor.columns()
        if found is None or len(cursor.rows) < len(own):
            raise ValueError(f"a record of tag {tag} does not hold its fields")
        found |= {"tag": pa.array(head["tag"][own]), "timestamp_ns": pa.array(np.ascontiguousarray(head["timestamp_ns"][own]))}
        tables.append(pa.Table.from_arrays([found[n].cast(t) if n in found else pa.nulls(len(own), t) for n, t in _TYPES], [n for n, _ in _TYPES]))
        order.append(own)
    table = pa.concat_tables(tables).take(pa.array(np.argsort(np.concatenate(order)))).combine_chunks()
    return table.to_batches()[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the journal files under a path, with their file and place in it."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                places = _places(data)
                for start in range(0, len(places), BATCH):
                    some = places[start : start + BATCH]
                    rows = _decoded(data, some)
                    ord_ = pa.array(np.arange(start, start + len(some)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([name] * len(some)), ord_], [*rows.schema.names, "path", "ord"])

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(run, f"{COLUMNS}, path string, ord long")


def encode_rows(entries: DataFrame) -> DataFrame:
    """(record) of journal rows."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_encoded(batch)], ["record"])

    return entries.select(*_NAMES).mapInArrow(run, "record binary")


def write(entries: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Write journal rows, in the order of each partition, as segments of at most so many records: (segment, records) of each, written when
    the result is read. A segment appears whole, under a name of its own; a task that runs again writes others, and only those that the
    result names count."""

    def run(batches):
        system, at = files.opened(folder)
        system.create_dir(at, recursive=True)
        held, out, name = 0, None, ""
        for batch in batches:
            for start in range(0, batch.num_rows, segment):
                part = batch.slice(start, segment)
                while part.num_rows:
                    if out is None:
                        name, held = f"{uuid.uuid4().hex}.log", 0
                        out = system.open_output_stream(f"{at}/.{name}")
                    some = part.slice(0, segment - held)
                    offsets, data = packed.bytes_of(_encoded(some))
                    out.write(data[offsets[0] : offsets[-1]].tobytes())
                    held, part = held + some.num_rows, part.slice(some.num_rows)
                    if held == segment:
                        out.close()
                        system.move(f"{at}/.{name}", f"{at}/{name}")
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held])], ["segment", "records"])
                        out = None
        if out is not None:
            out.close()
            system.move(f"{at}/.{name}", f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held])], ["segment", "records"])

    return entries.select(*_NAMES).mapInArrow(run, "segment string, records long")
