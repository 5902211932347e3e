"""Which tokens of one tokenizer stand for which of another, counted over a corpus.

Both tokenizers cut the same bytes; a token of A and one of B are linked where their byte ranges overlap. A link's id pair is packed into
one integer, counts of pairs are made a partition at a time, sorted over the whole cluster by ranges and summed run by run, and written as
shards of sorted keys. Scoring maps the shards into memory and looks pairs up by binary search, so no task holds the table of counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards
from .store import materialize, shared_folder, short_batches

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

#: Bytes of text that are encoded, or of ids that are linked, at a time
BLOCK = 1 << 20
#: Pairs that a task gathers before it counts them, and distinct pairs that it holds before it passes them on
GATHER, HOLD = 1 << 21, 1 << 21


def _byte_level() -> dict[str, int]:
    """The byte of each character of byte-level tokens: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: How the byte-level tokenizer cuts a text before its merges; a fixed value of that kind of tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers. A's file is run by ranks, which gives the same ids as its own library in a third of the time: that is checked to
    be so, as every merge must make the next id and nothing else may change the text."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        import sentencepiece
        import tiktoken

        file, level = json.loads(byte_bpe), _byte_level()
        vocabulary, merges, cut = file["model"]["vocab"], file["model"]["merges"], file["pre_tokenizer"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        if file["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True) or any(vocabulary[x + y] != 256 + i for i, (x, y) in enumerate(pairs)):
            raise ValueError("the byte-level file is not one of plain byte-level merges in the order of their ids")
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(level[c] for c in token)
        b = self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.id_to_piece(list(range(b.get_piece_size()))))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if x}, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Both encodings of a space and each text, as packed integers of 32 bits; empty for an empty text and where B's bytes are not
        those of the text. A's always are."""
        out_a, out_b, names = [], [], self.b_bytes
        for text, y in zip(texts, self._b.encode(texts, num_threads=1), strict=True):  # B puts the space there itself
            data = f" {text}".encode()
            right = bool(text) and b"".join([names[i] for i in y]) == data
            out_a.append(array("i", self._a.encode_ordinary(f" {text}")).tobytes() if right else b"")
            out_b.append(array("i", y).tobytes() if right else b"")
        return out_a, out_b


class Linked:
    """Links of several texts' tokens, laid end to end: ``a`` and ``b`` ids, the places there of each link's tokens, links of each text."""

    def __init__(self, a: list[bytes], b: list[bytes], a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.array([len(t) // 4 for t in x], np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[ends_a] = in_b[ends_b] = True
        # each stretch of bytes between neighbouring ends lies in one token of A and one of B: that is a link
        ends = np.flatnonzero(in_a | in_b)
        self.in_a, self.in_b = in_a[ends], in_b[ends]
        self.at_a, self.at_b = (np.cumsum(x) - x for x in (self.in_a, self.in_b))
        last = np.concatenate([[0], ends_a])[np.cumsum(self.n_a)]  # the byte at which each text ends
        self.links = np.diff(np.searchsorted(ends, last, "right"), prepend=0)

    def keys(self) -> np.ndarray:
        """The packed id pair of each link: B's id above A's, so that a B id's pairs are neighbours."""
        return (self.b[self.at_b] << 32) | self.a[self.at_a]

    def groups(self, signed: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Each text's number of groups, and its groups as ``1,2|7;3|8,9``, put together from ids with signs as ``signed_ids`` has them.
        A group ends where a token of A and one of B both end."""
        shared = self.in_a & self.in_b
        total = np.concatenate([[0], np.cumsum(shared)])
        n = np.diff(total[np.cumsum(self.links)], prepend=0)
        group_a, group_b = total[:-1][self.in_a], total[:-1][self.in_b]
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)  # tokens of each group
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        sign = np.empty(len(ids), np.int64)
        place_a, place_b = np.arange(len(self.a)) + before_b[group_a], np.arange(len(self.b)) + (before_a + in_a)[group_b]
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a] = np.append(group_a[1:], -1) != group_a
        sign[place_b] = 2 * (np.append(group_b[1:], -1) != group_b)
        ends = np.cumsum(self.n_a + self.n_b)
        sign[ends[ends > 0] - 1] = 3
        text = signed[sign, ids].tolist()
        return n, ["".join(text[start:end]) for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def signed_ids(size: int) -> np.ndarray:
    """Each id below ``size`` in decimal digits, followed by a comma, a bar, a semicolon or nothing."""
    return np.array([[f"{i}{sign}" for i in range(size)] for sign in (",", "|", ";", "")], object)


def _blocks(batch: pa.RecordBatch, sizes: list[int]):
    """Slices of a batch of at most BLOCK bytes, or of one row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > BLOCK:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _linked(batch: pa.RecordBatch, sizes):
    lengths = [len(x) for x in batch.column("a").to_pylist()]
    for part in _blocks(batch, lengths):
        yield part, Linked(part.column("a").to_pylist(), part.column("b").to_pylist(), *sizes)


def encode(docs: DataFrame, id_: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """A written table of (id, a, b, n_a, n_b, n_groups, n_links, groups_sha256), a row for each document, and both vocabularies' byte
    lengths. The tokenizer files are read here and broadcast; their size is fixed."""
    spark = docs.sparkSession
    short_batches(spark)
    files = spark.sparkContext.broadcast((Path(byte_bpe).read_text(), Path(pieces).read_bytes()))
    schema = pa.schema([("id", pa.string()), ("a", pa.binary()), ("b", pa.binary()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])

    def run(batches):
        both = Tokenizers(*files.value)
        signed = signed_ids(max(len(both.a_size), len(both.b_size)))
        for batch in batches:
            for part in _blocks(batch, [len(t or "") for t in batch.column("text").to_pylist()]):
                a, b = both.encode([t or "" for t in part.column("text").to_pylist()])
                found = Linked(a, b, both.a_size, both.b_size)
                groups, written = found.groups(signed)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in written]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(a), pa.array(b), *(pa.array(x) for x in (found.n_a, found.n_b, groups, found.links)), pa.array(digests)], schema=schema)

    ddl = "id string, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    tokens = materialize(docs.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, ddl), "tokens")
    both = Tokenizers(*files.value)
    return tokens, (both.a_size, both.b_size)


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of ``n`` (1 each)."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n): partial counts of the links' id pairs, each pair once a task or once for every HOLD pairs of it."""
    def run(batches):
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for _, found in _linked(batch, sizes):
                waiting.append(found.keys())
                size += len(waiting[-1])
                if size >= GATHER:
                    keys, counts = _counted(np.concatenate(waiting))
                    held, n = _counted(np.concatenate([held, keys]), np.concatenate([n, counts]))
                    waiting, size = [], 0
                    if len(held) >= HOLD:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["key", "n"])
                        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = _counted(np.concatenate([*waiting, held[:0]]))
        held, n = _counted(np.concatenate([held, keys]), np.concatenate([n, counts]))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["key", "n"])

    return materialize(tokens.select("a", "b").mapInArrow(run, "key long, n long"), "pair-counts")


def write_shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sum the counts by key and write them as shards, each a range of keys in order: a written table of one row a shard with its path
    and first key, and the highest count of each B id in it. A shard of a task that failed is in no row."""
    def run(batches):
        writer, first, last, total = None, None, None, 0
        best: dict[int, int] = {}

        def put(keys, n):
            nonlocal writer, first
            if not len(keys):
                return
            writer = writer or shards.Writer(f"{folder}/{uuid.uuid4().hex}")
            first = int(keys[0]) if first is None else first
            writer.put(keys, n)
            ids = keys >> 32
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for i, top in zip(ids[starts].tolist(), np.maximum.reduceat(n, starts).tolist(), strict=True):
                best[i] = max(best.get(i, 0), top)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = _counted(batch.column("key").to_numpy(), batch.column("n").to_numpy())
            if last == keys[0]:
                n[0] += total
            elif last is not None:
                put(np.array([last]), np.array([total]))
            last, total = int(keys[-1]), int(n[-1])  # its run may go on in the next batch
            put(keys[:-1], n[:-1])
        if last is not None:
            put(np.array([last]), np.array([total]))
            ids, tops = (pa.array([list(x)], pa.list_(pa.int64())) for x in (best, best.values()))
            yield pa.RecordBatch.from_arrays([pa.array([writer.close()]), pa.array([first]), ids, tops], ["path", "first", "b", "best"])

    sorted_ = partial.repartitionByRange("key").sortWithinPartitions("key")
    return materialize(sorted_.mapInArrow(run, "path string, first long, b array<long>, best array<long>"), "pair-shards")


def align(docs: DataFrame, id_: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """The id with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row, and its tokens ``a`` and ``b``
    (packed integers of 32 bits).

    A links a token of A (byte_bpe) with one of B (pieces) where their byte ranges overlap; ``n_best`` counts links whose pair is, over
    the corpus, the most frequent of its B id, ties included, and ``count_sum`` adds the pairs' counts. Texts that are null or empty, or
    that either tokenizer does not give back byte by byte after a space, have no tokens: zeros and an empty digest. Repeated rows count
    and are returned each time; ids may be null, other columns take no part, and an empty table gives an empty result. Counts are at
    most one row for each pair of ids, on disk; the highest counts of the B ids go through the driver.
    """
    spark: SparkSession = docs.sparkSession
    tokens, sizes = encode(docs, id_, text, byte_bpe, pieces)
    table = write_shards(pair_counts(tokens, sizes), f"{shared_folder(spark)}/pair-shards-{uuid.uuid4().hex}").collect()
    best = np.zeros(len(sizes[1]), np.int64)
    for row in table:
        np.maximum.at(best, np.array(row["b"], np.int64), np.array(row["best"], np.int64))
    shards.offer(spark, [row["path"] for row in table])
    index = spark.sparkContext.broadcast((best, sorted((row["first"], row["path"]) for row in table)))
    kind = docs.schema[id_].dataType

    def run(batches):
        best, parts = index.value
        counts = shards.Table(parts)
        for batch in batches:
            for part, found in _linked(batch, sizes):
                keys = found.keys()
                distinct, place = np.unique(keys, return_inverse=True)
                n = counts.find(distinct)[place]
                ends = np.cumsum(found.links)

                def summed(x, ends=ends):
                    return pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0))

                top = summed((n == best[keys >> 32]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), top, summed(n), *(part.column(c) for c in ("groups_sha256", "a", "b"))], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "a", "b"]
    out = tokens.mapInArrow(run, "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, a binary, b binary")
    return out.select(F.col("id").cast(kind).alias(id_), *names[1:])
