"""Fixed-layout binary messages: one table of layouts, and an encoder and a decoder that follow it, run over Arrow batches.

Messages and frames are packed and read a batch at a time, as arrays over the batch's bytes (``packed``); only a batch with a text that is
no UTF-8 is read one by one. Numbers are little-endian; texts have a 16-bit length before them; a side of a book is a 32-bit count, in the
feed a 16-bit size of an entry and an 8-bit count, and (price, qty) pairs.
"""

from __future__ import annotations

import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed

# The header's fields and their struct codes, and every message's own fields
HEADER = [("schema_version", "B"), ("message_type", "B"), ("venue_id", "B"), ("market_type", "B"), ("instrument_id", "I"), ("connection_id", "I"), ("instance_id", "I"), ("sequence_number", "Q"), ("exchange_event_ts", "q"), ("exchange_tx_ts", "q"), ("local_recv_ts", "q"), ("local_publish_ts", "q")]
_HEADER = struct.Struct("<" + "".join(c for _, c in HEADER))
HEADER_SIZE, PUBLISH_OFFSET = _HEADER.size, 48
_SYMBOL, _SCALES = ("symbol", "s"), [("price_scale", "B"), ("qty_scale", "B")]
LAYOUTS = {
    1: [_SYMBOL, ("base_asset", "s"), ("quote_asset", "s"), ("price_scale", "I"), ("qty_scale", "I"), ("tick_size", "q"), ("step_size", "q"), ("min_qty", "q"), ("min_notional", "q"), ("contract_size", "q"), ("is_trading", "?")],
    2: [_SYMBOL, ("is_trading", "?")],
    3: [_SYMBOL, *_SCALES, ("update_id", "Q"), ("bids", "l"), ("asks", "l")],
    4: [_SYMBOL, *_SCALES, ("first_update_id", "Q"), ("final_update_id", "Q"), ("prev_update_id", "Q"), ("bids", "l"), ("asks", "l")],
    5: [_SYMBOL, *_SCALES, ("bid_price", "q"), ("bid_qty", "q"), ("ask_price", "q"), ("ask_qty", "q"), ("update_id", "Q")],
    6: [_SYMBOL, *_SCALES, ("trade_id", "Q"), ("price", "q"), ("qty", "q"), ("trade_ts", "q"), ("is_buyer_maker", "?"), ("aggressor_side", "B")],
    7: [_SYMBOL, ("price_scale", "B"), ("mark_price", "q"), ("index_price", "q")],
    8: [_SYMBOL, ("funding_rate_scale", "B"), ("funding_rate", "q"), ("next_funding_time", "q")],
    9: [_SYMBOL, *_SCALES, ("side", "B"), ("price", "q"), ("qty", "q"), ("avg_price", "q"), ("last_filled_qty", "q")],
    10: [_SYMBOL, ("qty_scale", "B"), ("open_interest", "q")],
    11: [], 12: [], 13: [],
    14: [("state", "B")],
    15: [_SYMBOL, ("expected_update_id", "Q"), ("received_update_id", "Q")],
    16: [_SYMBOL, ("reason", "B")],
    17: [_SYMBOL, ("snapshot_update_id", "Q")],
    18: [_SYMBOL, ("update_id", "Q"), ("bid_depth", "I"), ("ask_depth", "I"), ("checksum", "Q")],
}
_TYPES = {"s": "string", "?": "boolean", "l": "array<struct<price:long,qty:long>>"}

#: The exchange's own binary feed: block length, template, schema and version, then the template's block, groups and symbol
SCHEMA_ID, NEWEST_VERSION = 3, 2
TEMPLATES = {
    0: [("event_us", "q"), ("transact_us", "q"), ("trade_id", "q"), ("price", "q"), ("qty", "q"), ("buyer_order_id", "q"), ("seller_order_id", "q"), ("aggressor_side", "B"), ("is_buyer_maker", "?")],
    1: [("event_us", "q"), ("transact_us", "q"), ("bid_price", "q"), ("bid_qty", "q"), ("ask_price", "q"), ("ask_qty", "q")],
    2: [("event_us", "q"), ("update_id", "q")],
    3: [("event_us", "q"), ("transact_us", "q"), ("first_id", "q"), ("final_id", "q"), ("prev_id", "q")],
}
_GROUPED = (2, 3)


def _segments(fields) -> list:
    """Runs of fixed fields as one struct each; texts and book sides stand alone."""
    out: list = []
    for _, code in fields:
        if code in "sl":
            out.append(code)
        elif out and isinstance(out[-1], list):
            out[-1].append(code)
        else:
            out.append([code])
    return [x if isinstance(x, str) else struct.Struct("<" + "".join(x)) for x in out]


def _pack(segments: list, values: tuple) -> bytes:
    parts, at = [], 0
    for seg in segments:
        if seg == "s":
            raw = values[at].encode()
            parts += (struct.pack("<H", len(raw)), raw)
            at += 1
        elif seg == "l":
            parts.append(struct.pack("<I", len(values[at])))
            parts += [struct.pack("<qq", x["price"], x["qty"]) for x in values[at]]
            at += 1
        else:
            n = len(seg.format) - 1
            parts.append(seg.pack(*values[at : at + n]))
            at += n
    return b"".join(parts)


def _unpack(segments: list, data: bytes, at: int) -> tuple[list, int]:
    """Values and the place after them; struct.error where the data end too early."""
    values: list = []
    for seg in segments:
        if seg == "s":
            (n,) = struct.unpack_from("<H", data, at)
            if at + 2 + n > len(data):
                raise struct.error("text beyond the end")
            values.append(data[at + 2 : at + 2 + n].decode())
            at += 2 + n
        elif seg == "l":
            (n,) = struct.unpack_from("<I", data, at)
            values.append([dict(zip(("price", "qty"), struct.unpack_from("<qq", data, at + 4 + 16 * i), strict=True)) for i in range(n)])
            at += 4 + 16 * n
        else:
            values += seg.unpack_from(data, at)
            at += seg.size
    return values, at


_MESSAGES = {t: _segments([*HEADER, *fields]) for t, fields in LAYOUTS.items()}
_BLOCKS = {t: _segments(fields) for t, fields in TEMPLATES.items()}
_BROKEN = (struct.error, UnicodeDecodeError)
_TYPE_AT = 1  # the header's byte that tells the message type


def _names(message_type: int) -> list[str]:
    return [n for n, _ in (*HEADER, *LAYOUTS[message_type])]


def encode_message(row: dict) -> bytes:
    """Header and payload of one message."""
    kind = int(row["message_type"])
    return _pack(_MESSAGES[kind], tuple(row[n] for n in _names(kind)))


def _decoded(data: bytes, message_type: int) -> list | None:
    if len(data) < HEADER_SIZE or data[_TYPE_AT] != message_type:
        return None
    try:
        return _unpack(_MESSAGES[message_type], data, 0)[0]
    except _BROKEN:
        return None


def decode_message(data: bytes, message_type: int) -> dict | None:
    """The fields of a message of the type; null if it is another or does not hold. Bytes after the last field are let be."""
    values = _decoded(data, message_type)
    return None if values is None else dict(zip(_names(message_type), values, strict=True))


def _schema(fields) -> str:
    return ", ".join(f"{n} {_TYPES.get(c, 'decimal(20,0)' if n == 'checksum' else 'long')}" for n, c in fields)


_NUMPY = {"B": "u1", "I": "<u4", "Q": "<i8", "q": "<i8", "?": "u1"}  # ids stay below 2 ** 63, as Spark's longs do
_ARROW = {"s": pa.string(), "?": pa.bool_(), "l": pa.list_(pa.struct([("price", pa.int64()), ("qty", pa.int64())]))}
#: What stands before a side of a book: kinds of numbers, with the value of constant ones
_SIDE, _GROUP = [("<u4", None)], [("<u2", 16), ("u1", None)]


def _layout(fields) -> list:
    """Texts and sides of books by name, and runs of numbers as record types, in order."""
    out: list = []
    for name, code in fields:
        kind = "<u8" if name == "checksum" else _NUMPY.get(code)
        if kind is None:
            out.append((name, code))
        elif out and isinstance(out[-1], list):
            out[-1].append((name, kind))
        else:
            out.append([(name, kind)])
    return [np.dtype(x) if isinstance(x, list) else x for x in out]


def _arrow(n: str, code: str) -> pa.DataType:
    return pa.decimal128(20, 0) if n == "checksum" else _ARROW.get(code, pa.int64())


def _packed(batch: pa.RecordBatch, layout: list, head: list) -> list[tuple]:
    """A batch's parts; ``head`` is what stands before a side of a book."""
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    return [packed.numbers(columns, x) if isinstance(x, np.dtype) else packed.texts(columns[x[0]], "<u2") if x[1] == "s" else packed.levels(columns[x[0]], head) for x in layout]


def _read(cursor: packed.Cursor, layout: list, head: list) -> None:
    for part in layout:
        if isinstance(part, np.dtype):
            cursor.numbers(part)
        elif part[1] == "s":
            cursor.text(part[0], "<u2")
        else:
            cursor.levels(part[0], [kind for kind, _ in head])


def _batch(columns: dict, fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if (x := columns[n]).type == (t := _arrow(n, c)) else x.cast(t) for n, c in fields], [n for n, _ in fields])


def _singly(rows: list, fields) -> pa.RecordBatch:
    """The rows, lists of values, of a batch that was read one by one."""
    return pa.RecordBatch.from_arrays([pa.array([Decimal(r[i]) if n == "checksum" else r[i] for r in rows], _arrow(n, c)) for i, (n, c) in enumerate(fields)], [n for n, _ in fields])


def encode(messages: DataFrame, message_type: int) -> DataFrame:
    """(payload) of messages that have the header's and the type's columns, none of them null."""
    layout = _layout([*HEADER, *LAYOUTS[message_type]])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([packed.pack(_packed(batch, layout, _SIDE))], ["payload"])

    return messages.select(*_names(message_type)).mapInArrow(run, "payload binary")


def decode(frames: DataFrame, message_type: int) -> DataFrame:
    """The rows of one message type; frames of other types and broken ones are left out."""
    fields = [*HEADER, *LAYOUTS[message_type]]
    layout = _layout(fields)

    def run(batches):
        for batch in batches:
            column = batch.column(0).drop_null()
            offsets, data = packed.bytes_of(column)
            cursor = packed.Cursor(data, offsets[:-1], offsets[1:])
            cursor.keep(cursor.end - cursor.at >= HEADER_SIZE)
            cursor.keep(data[cursor.at + _TYPE_AT] == message_type)
            _read(cursor, layout, _SIDE)
            columns = cursor.columns()
            if columns is None:
                yield _singly([r for r in (_decoded(x, message_type) for x in column.to_pylist()) if r is not None], fields)
            else:
                yield _batch(columns, fields)

    return frames.select("payload").mapInArrow(run, _schema(fields))


def headers(frames: DataFrame) -> DataFrame:
    """The header of every frame of at least its size, read by column functions alone; the payload after it is not looked at."""
    at, columns = 1, []
    for name, code in HEADER:
        n = struct.calcsize("<" + code)
        columns.append(F.conv(F.hex(_reversed("payload", at, n)), 16, -10).cast("long").alias(name))
        at += n
    return frames.where(F.octet_length("payload") >= HEADER_SIZE).select(*columns)


def _reversed(payload: str, at: int, n: int):
    return F.concat(*[F.substring(payload, at + n - 1 - i, 1) for i in range(n)])


def encode_feed(row: dict, template: int) -> bytes:
    """One frame of the exchange's binary feed."""
    block = _pack(_BLOCKS[template], tuple(row[n] for n, _ in TEMPLATES[template]))
    groups = b""
    if template in _GROUPED:
        for side in ("bids", "asks"):
            groups += struct.pack("<HB", 16, len(row[side])) + b"".join(struct.pack("<qq", x["price"], x["qty"]) for x in row[side])
    return struct.pack("<HHHH", len(block), template, SCHEMA_ID, NEWEST_VERSION) + block + groups + _pack(["s"], (row["symbol"],))


def decode_feed_frame(data: bytes, template: int) -> dict | None:
    """A frame of the template, schema and a version that is known; blocks and entries longer than known are skipped over."""
    try:
        length, found, schema, version = struct.unpack_from("<HHHH", data)
        if found != template or schema != SCHEMA_ID or version > NEWEST_VERSION:
            return None
        values, at = _unpack(_BLOCKS[template], data, 8)
        out = dict(zip((n for n, _ in TEMPLATES[template]), values, strict=True))
        at = max(at, 8 + length)
        if template in _GROUPED:
            for side in ("bids", "asks"):
                size, n = struct.unpack_from("<HB", data, at)
                out[side] = [dict(zip(("price", "qty"), struct.unpack_from("<qq", data, at + 3 + size * i), strict=True)) for i in range(n)]
                at += 3 + size * n
        (out["symbol"],), _ = _unpack(["s"], data, at)
    except _BROKEN:
        return None
    return out


def _feed_fields(template: int):
    return [*TEMPLATES[template], *([("bids", "l"), ("asks", "l")] if template in _GROUPED else []), _SYMBOL]


_FEED_HEAD = np.dtype([("length", "<u2"), ("template", "<u2"), ("schema", "<u2"), ("version", "<u2")])


def to_feed(rows: DataFrame, template: int) -> DataFrame:
    """(payload) of frames of a template."""
    fields = _feed_fields(template)
    layout = _layout(fields)
    length = sum(x.itemsize for x in layout if isinstance(x, np.dtype))

    def run(batches):
        for batch in batches:
            head = np.zeros(batch.num_rows, _FEED_HEAD)
            head[:] = (length, template, SCHEMA_ID, NEWEST_VERSION)
            parts = [(head.view(np.uint8).reshape(len(head), _FEED_HEAD.itemsize), None, None), *_packed(batch, layout, _GROUP)]
            yield pa.RecordBatch.from_arrays([packed.pack(parts)], ["payload"])

    return rows.select(*[n for n, _ in fields]).mapInArrow(run, "payload binary")


def _read_feed(column: pa.Array, template: int) -> packed.Cursor:
    """A cursor behind the frames of the template, schema and a version that is known; what a block has beyond its known fields is
    skipped."""
    offsets, data = packed.bytes_of(column)
    cursor = packed.Cursor(data, offsets[:-1], offsets[1:])
    cursor.keep(cursor.end - cursor.at >= _FEED_HEAD.itemsize)
    head = np.ascontiguousarray(data[cursor.at[:, None] + np.arange(_FEED_HEAD.itemsize)]).view(_FEED_HEAD).reshape(-1)
    known = (head["template"] == template) & (head["schema"] == SCHEMA_ID) & (head["version"] <= NEWEST_VERSION)
    start, length = (cursor.at + _FEED_HEAD.itemsize)[known], head["length"][known].astype(np.int64)
    cursor.keep(known)
    cursor.at = start
    block, *rest = _layout(_feed_fields(template))
    fits = start + block.itemsize <= cursor.end
    cursor.numbers(block)
    cursor.at = np.maximum(cursor.at, (start + length)[fits])
    _read(cursor, rest, _GROUP)
    return cursor


def from_feed(frames: DataFrame, template: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of one template, with the columns ``keep`` of their frames; other frames and broken ones are left out."""
    fields, kept = _feed_fields(template), [frames.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            there = batch.filter(batch.column("payload").is_valid())
            cursor = _read_feed(there.column("payload"), template)
            columns, rows = cursor.columns(), cursor.rows
            if columns is None:
                found = [(i, r) for i, x in enumerate(there.column("payload").to_pylist()) if (r := decode_feed_frame(x, template)) is not None]
                rows, out = np.array([i for i, _ in found], np.int64), _singly([[r[n] for n, _ in fields] for _, r in found], fields)
            else:
                out = _batch(columns, fields)
            own = [there.column(c).take(pa.array(rows)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out.columns, *own], [*out.schema.names, *keep])

    schema = ", ".join([_schema(fields), *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])
    return frames.select("payload", *keep).mapInArrow(run, schema)


def decode_feed(frames: DataFrame, template: int) -> DataFrame:
    """Every frame with all its columns and ``feed``: a struct of the template's fields, null for other frames and broken ones. Nothing is
    dropped, so a frame can be read in another way where it is null, without reading it a second time."""
    fields = _feed_fields(template)
    kinds = pa.struct([(n, _arrow(n, c)) for n, c in fields])

    def run(batches):
        for batch in batches:
            valid = np.flatnonzero(batch.column("payload").is_valid().to_numpy(zero_copy_only=False))
            column = batch.column("payload").drop_null()
            cursor = _read_feed(column, template)
            columns, rows = cursor.columns(), cursor.rows
            if columns is None:
                feed = pa.array([None if x is None else decode_feed_frame(x, template) for x in batch.column("payload").to_pylist()], kinds)
            else:
                found = _batch(columns, fields)
                place = np.full(batch.num_rows, -1)
                place[valid[rows]] = np.arange(len(rows))
                feed = pa.StructArray.from_arrays(found.columns, fields=list(kinds)).take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, feed], [*batch.schema.names, "feed"])

    return frames.mapInArrow(run, T.StructType([*frames.schema.fields, T.StructField("feed", T.StructType.fromDDL(_schema(fields)))]))
