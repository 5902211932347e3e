"""The checksum sink's commits, and recorded shards read by ranges and by offsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marketlens.sources import checksum_sink, recorded

CHECKS = "symbol string, update_id long, bid_depth long, ask_depth long, checksum string"


def checks(spark, n, start=0):
    return spark.createDataFrame([(f"S{i}", i, i % 7, i % 5, f"{(i * 2654435761) << 20 | 1 << 63 if i % 2 else i:016x}") for i in range(start, start + n)], CHECKS)


def read(spark, folder):
    return sorted(map(tuple, spark.read.format("book_checksums").option("path", str(folder)).load().select(*checksum_sink.FIELDS).collect()))


def test_rows_come_back_and_results_are_told(spark, tmp_path):
    checksum_sink.register(spark)
    good, bad = checks(spark, 50), spark.createDataFrame([("x" * 65_536, 1, 1, 1, "00"), (None, 1, 1, 1, "00"), ("A", 1, 1, 1, None)], CHECKS)
    write = good.unionByName(bad).repartition(3).write.format("book_checksums").mode("append").option("path", str(tmp_path / "out"))
    write.save()
    assert read(spark, tmp_path / "out") == sorted(map(tuple, good.collect()))
    assert [c["results"] for c in checksum_sink.commits(str(tmp_path / "out"))] == [{"Ok": 50, "Closed": 3}]
    checks(spark, 5, 100).write.format("book_checksums").mode("append").option("path", str(tmp_path / "out")).save()
    assert len(read(spark, tmp_path / "out")) == 55
    with pytest.raises(Exception, match="append"):
        good.write.format("book_checksums").mode("overwrite").option("path", str(tmp_path / "out")).save()


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    checksum_sink.register(spark)
    checks(spark, 10).write.format("book_checksums").mode("append").option("path", str(tmp_path / "out")).save()
    broken = checks(spark, 40).repartition(4).withColumn("checksum", F.when(F.col("update_id") == 17, F.lit("no number")).otherwise(F.col("checksum")))
    with pytest.raises(Exception):
        broken.write.format("book_checksums").mode("append").option("path", str(tmp_path / "out")).save()
    assert len(read(spark, tmp_path / "out")) == 10 and len(checksum_sink.commits(str(tmp_path / "out"))) == 1
    # what a task that was lost left behind is not read either
    (tmp_path / "out" / "lost.bin").write_bytes(b"\x10\0\0\0half")
    assert len(read(spark, tmp_path / "out")) == 10


def test_a_streams_batch_is_committed_once(spark, tmp_path):
    checksum_sink.register(spark)
    for i in range(3):
        checks(spark, 20, 100 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHECKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # with a checkpoint that is lost, all batches are run again
        stream.writeStream.format("book_checksums").option("path", out).option("checkpointLocation", str(tmp_path / f"ck{_}")).trigger(availableNow=True).start().awaitTermination()
        assert len(read(spark, out)) == 60
    writer = checksum_sink._StreamWriter(out)
    again = writer.write(iter(checks(spark, 20).collect()))
    writer.commit([again, None], 0)
    assert len(read(spark, out)) == 60 and not os.path.exists(f"{out}/{again.file}")


def frames(folder, shard, start, n, long=0):
    with open(folder / f"{shard}.jsonl", "a") as f:
        for i in range(start, start + n):
            f.write(json.dumps({"captured_at_ns": i, "source_kind": recorded.KINDS[i % 3], "payload": f"{shard}-{i}-" + "é" * (long * (i % 4))}) + "\n")


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_ranges_meet_each_line_once(spark, tmp_path, split):
    frames(tmp_path, "a", 0, 20, long=5)
    frames(tmp_path, "b", 0, 1)
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.jsonl").write_text('\n\n{"captured_at_ns": 5, "source_kind": "archive", "payload": "d-5-"}')
    (tmp_path / "_SUCCESS.jsonl").write_text("not read")
    ends = {f: os.path.getsize(tmp_path / f) for f in ("a.jsonl", "b.jsonl", "c.jsonl", "d.jsonl")}
    got = [row for part in recorded._ranges(str(tmp_path), {}, ends, split) for row in recorded._rows(part)]
    assert sorted(r[4].rsplit("-", 1)[0] for r in got) == sorted([f"a-{i}" for i in range(20)] + ["b-0", "d-5"])
    for shard, at, *_ in got:  # a position is where the line stands
        with open(tmp_path / shard, "rb") as f:
            f.seek(at)
            assert json.loads(f.readline())
    if split > 30:
        recorded.register(spark)
        assert spark.read.format("recorded_frames").option("path", str(tmp_path)).option("splitBytes", split).load().count() == 22


def test_lines_over_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(recorded, "BLOCK", 16)
    frames(tmp_path, "a", 0, 9, long=9)
    size = os.path.getsize(tmp_path / "a.jsonl")
    for split in (5, 50, size):
        assert [r[2] for p in recorded._ranges(str(tmp_path), {}, {"a.jsonl": size}, split) for r in recorded._rows(p)] == list(range(9))
    reader = recorded._StreamReader(str(tmp_path), ".jsonl", 100, 1000)
    reader.initialOffset()
    seen, start = [], {}
    for _ in range(30):
        end = reader.latestOffset()
        seen.append([r[2] for p in reader.partitions(start, end) for r in recorded._rows(p)])
        start = end
    assert sum(seen, []) == list(range(9)) and len([s for s in seen if s]) > 3


def test_shards_grow_and_appear_while_a_stream_runs(spark, tmp_path):
    recorded.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    frames(folder, "a", 0, 30)

    def start():
        stream = spark.readStream.format("recorded_frames").option("path", str(folder)).option("bytesPerBatch", 500).load()
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()

    def seen():
        return sorted(r["payload"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    query = start()
    query.processAllAvailable()
    assert seen() == sorted(f"a-{i}-" for i in range(30))
    frames(folder, "a", 30, 10)
    frames(folder, "b", 0, 10)
    with open(folder / "b.jsonl", "a") as f:
        f.write('{"captured_at_ns": 99')  # half a line
    query.processAllAvailable()
    query.stop()
    want = [f"a-{i}-" for i in range(40)] + [f"b-{i}-" for i in range(10)]
    assert seen() == sorted(want)
    with open(folder / "b.jsonl", "a") as f:
        f.write(', "source_kind": "archive", "payload": "b-99-"}\n')
    frames(folder, "c", 0, 5)
    query = start()  # goes on from its checkpoint: nothing twice, nothing lost
    query.processAllAvailable()
    query.stop()
    assert seen() == sorted([*want, "b-99-", *(f"c-{i}-" for i in range(5))])
