"""Records of numbers, texts and lists over the bytes of an Arrow column, a batch at a time: packed by parts, read by a cursor in each row.

A variable part is a prefix and a span of bytes, so texts, optional numbers and repeating groups are packed alike; a group's entries are
read through two levels of offsets, those of the rows and those of the entries within.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LEVEL = np.dtype([("price", "<i8"), ("qty", "<i8")])


def spread(start: np.ndarray, length: np.ndarray, step: np.ndarray | int = 1) -> np.ndarray:
    """All places of spans, one span after the other; ``step`` is the distance of a span's places."""
    end = np.cumsum(length)
    within = np.arange(end[-1] if len(end) else 0) - np.repeat(end - length, length)
    return np.repeat(start, length) + within * (np.repeat(step, length) if isinstance(step, np.ndarray) else step)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of a binary or text column without nulls, and its bytes."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def numbers(columns: dict[str, pa.Array], kind: np.dtype) -> tuple:
    """A part of fixed fields."""
    records = np.zeros(len(next(iter(columns.values()))), kind)
    for name in kind.names:
        column = columns[name]
        records[name] = (column.cast(pa.uint64()) if pa.types.is_decimal(column.type) else column).to_numpy(zero_copy_only=False)
    return records.view(np.uint8).reshape(len(records), kind.itemsize), None, None


def texts(column: pa.Array, prefix: str) -> tuple:
    """A part of a text with its length before it, a number of type ``prefix``; a text that is too long for it is an error."""
    offsets, data = bytes_of(column)
    length = np.diff(offsets)
    if len(length) and length.max() > np.iinfo(prefix).max:
        raise ValueError("a text is longer than its length field can tell")
    return _prefixed(length, prefix), length, data[offsets[0] : offsets[-1]]


def levels(column: pa.Array, head: list[tuple[str, int | None]]) -> tuple:
    """A part of a list of (price, qty) with fields before it: constants, and the number of entries where there is none."""
    n = len(column)
    offsets = np.asarray(column.offsets, np.int64) if n else np.zeros(1, np.int64)
    count, entries = np.diff(offsets), column.values
    records = np.zeros(int(offsets[-1] - offsets[0]), LEVEL)
    for name in LEVEL.names:
        records[name] = entries.field(name).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    prefix = np.concatenate([_prefixed(count if value is None else np.full(n, value), kind) for kind, value in head], axis=1)
    return prefix, count * LEVEL.itemsize, records.view(np.uint8)


def optional(column: pa.Array) -> tuple:
    """A part of a byte that tells whether a number follows, and the number."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return there.astype(np.uint8)[:, None], there * 8, column.drop_null().to_numpy().astype("<i8").view(np.uint8)


def _prefixed(values: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)


def pack(parts: list[tuple]) -> pa.Array:
    """A binary column: each row's parts one after the other."""
    n = len(parts[0][0])
    sizes = sum(prefix.shape[1] + (0 if length is None else length) for prefix, length, _ in parts) + np.zeros(n, np.int64)
    ends = np.cumsum(sizes)
    out, at = np.zeros(int(ends[-1]) if n else 0, np.uint8), ends - sizes
    for prefix, length, data in parts:
        out[at[:, None] + np.arange(prefix.shape[1])] = prefix
        at = at + prefix.shape[1]
        if length is not None:
            out[spread(at, length)] = data
            at = at + length
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)])


class Cursor:
    """A place in each of several spans of bytes. What does not fit takes a row out; ``rows`` numbers the ones that are left."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.data, self.at, self.end, self.rows = data, at, end, np.arange(len(at))
        self._read: list[tuple[str, str, np.ndarray, tuple]] = []

    def keep(self, alive: np.ndarray) -> None:
        if not alive.all():
            self.at, self.end, self.rows = self.at[alive], self.end[alive], self.rows[alive]

    def _fixed(self, kind: np.dtype) -> np.ndarray:
        self.keep(self.at + kind.itemsize <= self.end)
        found = np.ascontiguousarray(self.data[self.at[:, None] + np.arange(kind.itemsize)]).view(kind).reshape(-1)
        self.at = self.at + kind.itemsize
        return found

    def number(self, kind: str) -> np.ndarray:
        return self._fixed(np.dtype(kind)).astype(np.int64)

    def numbers(self, kind: np.dtype) -> None:
        """Fields of a record type."""
        found = self._fixed(kind)
        self._read.append(("numbers", "", self.rows, (found,)))

    def text(self, name: str, prefix: str) -> None:
        length = self.number(prefix)
        alive = self.at + length <= self.end
        length = length[alive]
        self.keep(alive)
        self._read.append(("text", name, self.rows, (self.at, length)))
        self.at = self.at + length

    def levels(self, name: str, head: list[str]) -> None:
        """(price, qty) entries after their number, or after their size and number."""
        size, n = (np.full(0, 0), None)
        for kind in head:
            before = self.rows
            value = self.number(kind)
            if n is not None:
                size = n[np.isin(before, self.rows)] if len(before) != len(self.rows) else n
            n = value
        if len(head) == 1:
            size = np.full(len(n), LEVEL.itemsize)
        alive = (n == 0) | (self.at + size * (n - 1) + LEVEL.itemsize <= self.end)
        size, n = size[alive], n[alive]
        self.keep(alive)
        self._read.append(("levels", name, self.rows, (self.at, n, size)))
        self.at = self.at + size * n

    def optional(self, name: str) -> None:
        there = self.number("u1") != 0
        alive = ~there | (self.at + 8 <= self.end)
        there = there[alive]
        self.keep(alive)
        self._read.append(("optional", name, self.rows, (self.at, there)))
        self.at = self.at + 8 * there

    def columns(self) -> dict[str, pa.Array] | None:
        """What was read in the rows that are left, by field; None where a text is no UTF-8."""
        out: dict[str, pa.Array] = {}
        for what, name, rows, values in self._read:
            left = np.isin(rows, self.rows, assume_unique=True)
            values = tuple(v[left] for v in values)
            if what == "numbers":
                out |= {n: pa.array(np.ascontiguousarray(values[0][n])) for n in values[0].dtype.names}
            elif what == "text":
                ends = np.append(0, np.cumsum(values[1])).astype(np.int32)
                text = np.ascontiguousarray(self.data[spread(*values)])
                out[name] = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)])
                try:
                    out[name].validate(full=True)
                except pa.ArrowInvalid:
                    return None
            elif what == "levels":
                at, n, size = values
                entry = spread(at, n, size)
                records = np.ascontiguousarray(self.data[entry[:, None] + np.arange(LEVEL.itemsize)]).view(LEVEL).reshape(-1)
                struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(records[f])) for f in LEVEL.names], list(LEVEL.names))
                out[name] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), struct)
            else:
                at, there = values
                found = np.zeros(len(at), np.int64)
                found[there] = np.ascontiguousarray(self.data[at[there][:, None] + np.arange(8)]).view("<i8").reshape(-1)
                out[name] = pa.array(found, mask=~there)
        return out
