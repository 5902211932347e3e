"""Binary layouts, journal, configuration, recorded frames."""

import json
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.sources import binary, config, journal, recorded

HEADER = {"schema_version": 1, "venue_id": 1, "market_type": 1, "instrument_id": 1, "connection_id": 0, "instance_id": 1, "sequence_number": 1, "exchange_event_ts": 1_700_000_000_000_000_000, "exchange_tx_ts": 0, "local_recv_ts": 1_700_000_000_000_010_000, "local_publish_ts": 1_700_000_000_000_020_000}
LONG = st.integers(-(2**63), 2**63 - 1)
VALUES = {"s": st.text(max_size=20), "?": st.booleans(), "q": LONG, "Q": st.integers(0, 2**64 - 1), "I": st.integers(0, 2**32 - 1), "B": st.integers(0, 255), "l": st.lists(st.fixed_dictionaries({"price": LONG, "qty": LONG}), max_size=4)}


@settings(max_examples=60, deadline=None)
@given(st.data(), st.sampled_from(sorted(binary.LAYOUTS)))
def test_messages_come_back(data, kind):
    row = HEADER | {"message_type": kind} | {n: data.draw(VALUES[c]) for n, c in binary.LAYOUTS[kind]}
    raw = binary.encode_message(row)
    assert binary.decode_message(raw + b"later fields", kind) == row
    assert binary.decode_message(raw, kind % 18 + 1) is None
    assert all(binary.decode_message(raw[:n], kind) is None for n in (0, 10, binary.HEADER_SIZE - 1))


def test_header_layout():
    raw = binary.encode_message(HEADER | {"message_type": 13})
    assert len(raw) == 56 and raw[:4] == bytes([1, 13, 1, 1]) and raw[16:24] == (1).to_bytes(8, "little")


@settings(max_examples=40, deadline=None)
@given(st.data(), st.sampled_from(sorted(binary.TEMPLATES)))
def test_feed_frames_come_back(data, template):
    row = {n: data.draw(VALUES[c]) for n, c in binary.TEMPLATES[template]} | {"symbol": data.draw(st.text(max_size=9))}
    if template in (2, 3):
        row |= {s: data.draw(VALUES["l"]) for s in ("bids", "asks")}
    raw = binary.encode_feed(row, template)
    assert binary.decode_feed_frame(raw, template) == row
    assert binary.decode_feed_frame(raw[:4] + b"\x09\x00" + raw[6:], template) is None  # another schema
    assert binary.decode_feed_frame(raw[:6] + b"\x03\x00" + raw[8:], template) is None  # a newer version


def test_journal(spark, tmp_path):
    rows = [
        {"tag": 1, "timestamp_ns": 5, "cloid": "cc-0001-0000000000000001", "symbol": "BTCUSDT", "side": 0, "order_type": 0, "time_in_force": 0, "qty": 9, "limit_price": None},
        {"tag": 3, "timestamp_ns": 6, "cloid": "cc-0001-0000000000000001", "qty": 4, "price": 7, "is_final": False},
        {"tag": 5, "timestamp_ns": 7, "cloid": "x", "reason": "no"},
    ]
    data = b"".join(map(journal.encode, rows))
    assert list(journal.decode(data + data[:9])) == rows
    (tmp_path / "j.log").write_bytes(data)
    (tmp_path / "empty.log").write_bytes(b"")
    got = journal.read(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["tag"], r["cloid"], r["qty"], r["reason"]) for r in got] == [(1, rows[0]["cloid"], 9, None), (3, rows[0]["cloid"], 4, None), (5, "x", None, "no")]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[connector]\ninstance_id = 1\ntotal_instances = 4\nsymbols = ["A"]\n')
    s = config.load(str(tmp_path / "c.toml"), {"CONNECTOR__CONNECTOR__TOTAL_SHARDS": "8", "CONNECTOR__SYMBOLS": "X,Y"})
    assert s.owned_shards() == [1, 5] and s.symbols == ["X", "Y"]
    with pytest.raises(ValueError):
        config.load(None, {"CONNECTOR__TOTAL_SHARDS": "12"})


def test_recorded_frames(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("".join(json.dumps({"captured_at_ns": 10 * i + j, "source_kind": "raw_ws", "payload": f"{i}{j}"}) + "\n" for j in range(2)))
    recorded.register(spark)
    assert spark.read.format("recorded_frames").option("path", str(tmp_path)).load().count() == 6
    q = spark.readStream.format("recorded_frames").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        assert spark.table("frames").count() == 6
    finally:
        q.stop()


def levels(rng):
    return [{"price": rng.randrange(-(2**63), 2**63), "qty": rng.randrange(9)} for _ in range(rng.choice([0, 0, 1, 3]))]


def plain(row):
    return {n: int(x) if isinstance(x, Decimal) else x for n, x in row.items()}


def test_feed_batches_are_read_as_single_frames_are(spark):
    rng = random.Random(3)
    for template in binary.TEMPLATES:
        fields = binary._feed_fields(template)
        value = {"s": lambda: rng.choice(["", "BTCUSDT", "\u00fc \U0001f600"]), "?": lambda: rng.random() < 0.5, "B": lambda: rng.randrange(256), "q": lambda: rng.randrange(-(2**63), 2**63), "l": lambda: levels(rng)}
        rows = [{n: value[c]() for n, c in fields} for _ in range(40)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], binary._schema(fields))
        payloads = [bytes(r["payload"]) for r in binary.to_feed(df, template).collect()]
        assert sorted(payloads) == sorted(binary.encode_feed(r, template) for r in rows)
        x, size = payloads[0], sum({"q": 8, "B": 1, "?": 1}[c] for _, c in binary.TEMPLATES[template])
        longer = (size + 3).to_bytes(2, "little") + x[2 : 8 + size] + b"new" + x[8 + size :]  # a block with fields that are not known
        shorter = (size - 1).to_bytes(2, "little") + x[2:]
        wide = b"" if template < 2 else x[: 8 + size] + b"\x14\0\x02" + bytes(range(40)) + b"\x10\0\0" + b"\x01\0A"  # entries of 20 bytes
        narrow = b"" if template < 2 else x[: 8 + size] + b"\x04\0\x02" + bytes(range(8)) + b"\x10\0\0" + b"\x01\0A" + bytes(20)
        broken = [None, b"", b"abc", x[:8], x[:-1], x[: 8 + size + 1], longer, shorter, wide, narrow, x[:6] + b"\x03\0" + x[8:], x[:2] + b"\x07\0" + x[4:]]
        want = [binary.decode_feed_frame(b, template) for b in [*payloads, *broken] if b is not None]
        frames = spark.createDataFrame([(i, b) for i, b in enumerate([*payloads, *broken])], "i long, payload binary")
        got = [r.asDict(recursive=True) for r in binary.from_feed(frames, template).collect()]
        assert sorted(map(repr, got)) == sorted(repr(w) for w in want if w is not None)
        every = binary.decode_feed(frames, template).collect()
        assert {r["i"]: r["feed"] and r["feed"].asDict(recursive=True) for r in every} == {i: b and binary.decode_feed_frame(b, template) or None for i, b in enumerate([*payloads, *broken])}
        spoilt = spark.createDataFrame([(x,), (x[:-1] + b"\xff",)] if rows else [], "payload binary")
        assert len(binary.from_feed(spoilt, template).collect()) == sum(binary.decode_feed_frame(b, template) is not None for b in (x, x[:-1] + b"\xff"))


def test_journal_batches_are_single_records(spark, tmp_path):
    rng = random.Random(4)
    value = {"b": lambda: rng.choice(["", "cc-1", "\u00fc"]), "s": lambda: "why " * rng.randrange(90), "B": lambda: rng.randrange(256), "q": lambda: rng.randrange(-(2**63), 2**63), "Q": lambda: rng.randrange(2**63), "?": lambda: rng.random() < 0.5, "?q": lambda: rng.choice([None, 0, -5, 2**62])}
    rows = [{"tag": (tag := rng.choice(sorted(journal.RECORDS))), "timestamp_ns": rng.randrange(2**62)} | {n: value[c]() for n, c in journal.RECORDS[tag][1]} for _ in range(300)]
    df = spark.createDataFrame([tuple(r.get(n) for n in journal._NAMES) for r in rows], journal.COLUMNS).coalesce(1)
    want = [journal.encode(r) for r in rows]
    assert [bytes(r["record"]) for r in journal.encode_rows(df).collect()] == want
    segments = journal.write(df, str(tmp_path / "out"), segment=64).collect()
    assert [r["records"] for r in segments] == [64, 64, 64, 64, 44]
    assert b"".join((tmp_path / "out" / r["segment"]).read_bytes() for r in segments) == b"".join(want)
    got = [r for r in journal.read(spark, str(tmp_path / "out")).collect()]
    assert sorted(repr({n: r[n] for n in journal._NAMES}) for r in got) == sorted(repr({n: x.get(n) for n in journal._NAMES}) for x in rows)
    (tmp_path / "cut.log").write_bytes(b"".join(want)[:-1])
    assert journal.read(spark, str(tmp_path / "cut.log")).count() == 299
    (tmp_path / "bad.log").write_bytes(b"\x09" + want[0][1:])
    with pytest.raises(Exception, match="unknown record tags"):
        journal.read(spark, str(tmp_path / "bad.log")).collect()


def test_batches_are_read_as_single_messages_are(spark):
    rng = random.Random(2)
    for kind in (1, 3, 4, 5, 6, 13, 14, 18):
        fields = binary.LAYOUTS[kind]
        value = {"s": lambda: rng.choice(["", "BTCUSDT", "\u00fc\u00f1\u00ef \U0001f600"]), "?": lambda: rng.random() < 0.5, "B": lambda: rng.randrange(256), "I": lambda: rng.randrange(2**32), "Q": lambda: rng.randrange(2**63), "q": lambda: rng.randrange(-(2**63), 2**63), "l": lambda: levels(rng)}
        rows = [HEADER | {"message_type": kind} | {n: value[c]() for n, c in fields} for _ in range(40)]
        schema = binary._schema([*binary.HEADER, *fields])
        names = [n for n, _ in (*binary.HEADER, *fields)]
        df = spark.createDataFrame([tuple(Decimal(r[n]) if n == "checksum" else r[n] for n in names) for r in rows], schema)
        payloads = [bytes(r["payload"]) for r in binary.encode(df, kind).collect()]
        assert sorted(payloads) == sorted(map(binary.encode_message, rows))
        broken = [None, b"", b"x", payloads[0][:30], payloads[1][:-1], payloads[2] + b"later", payloads[3][:57], bytes([1, kind + 1]) + payloads[4][2:]]
        want = [binary.decode_message(x, kind) for x in payloads + broken if x is not None]
        frames = spark.createDataFrame([(x,) for x in payloads + broken], "payload binary")
        got = [plain(r.asDict(recursive=True)) for r in binary.decode(frames, kind).collect()]
        assert sorted(map(repr, got)) == sorted(repr(x) for x in want if x is not None)
    bad = binary.encode_message(HEADER | {"message_type": 17, "symbol": "ab", "snapshot_update_id": 4})
    at = bad.index(b"ab")
    frames = spark.createDataFrame([(bad,), (bad[:at] + b"\xff\xfe" + bad[at + 2 :],)], "payload binary")
    assert [r["symbol"] for r in binary.decode(frames, 17).collect()] == ["ab"]
