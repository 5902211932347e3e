"""Fill-in-the-middle: each text cut at two seeded code points and put together anew around sentinels.

Cuts are drawn in code points, texts are stored in UTF-8. An index of the distinct texts answers "at which byte does code point k begin?":
texts are grouped by a digest, the members of a group are compared byte by byte, and each distinct text gets one Elias-Fano list of the
bytes at which its code points begin, from which each document selects its two cuts. A text is shuffled once, with the ids of its
documents; only those of very many documents are joined with them by their digest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, short_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text of more documents than this, and than one in MOST_HOT of all, is looked up by several tasks
HOT_TEXT = 200
#: So many texts can be that frequent at most, whatever the table's size
MOST_HOT = 10_000
#: Bits of an Elias-Fano list between two entries of its directory
STRIDE = 512

LIST = "n long, width int, low binary, high binary, marks binary"
_FIELDS = [x.split()[0] for x in LIST.split(", ")]


def boundaries(data: bytes) -> np.ndarray:
    """The bytes at which the code points of UTF-8 ``data`` begin, and its length."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def encode_list(values: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """Elias-Fano form of an ascending list: its length less one, the width of low parts, low parts, unary high parts, and for each
    STRIDE of these the number of values before it."""
    universe, m = int(values[-1]) + 1, len(values)
    width = max(0, (universe // m).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    bits = np.zeros((int(values[-1] >> width) + m + STRIDE - 1) // STRIDE * STRIDE, np.uint8)
    bits[(values >> width) + np.arange(m)] = 1
    ones = bits.reshape(-1, STRIDE).sum(axis=1, dtype=np.int64)
    marks = (np.cumsum(ones) - ones).astype("<i8")
    return m - 1, width, np.packbits(low.ravel()).tobytes(), np.packbits(bits).tobytes(), marks.tobytes()


def select(k: int, width: int, low: bytes, high: bytes, marks: bytes) -> int:
    """The list's value number ``k``."""
    before = np.frombuffer(marks, "<i8")
    block = int(np.searchsorted(before, k, "right")) - 1
    part = np.unpackbits(np.frombuffer(high, np.uint8, STRIDE // 8, block * (STRIDE // 8)))
    at = block * STRIDE + int(np.flatnonzero(part)[k - int(before[block])])
    value = (at - k) << width
    for bit in range(width):
        place = k * width + bit
        value |= (low[place >> 3] >> (7 - (place & 7)) & 1) << bit
    return value


def _lists(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([encode_list(boundaries(bytes(t))) for t in texts], columns=_FIELDS)


def _select(k: pd.Series, width: pd.Series, low: pd.Series, high: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([select(int(a), int(b), *rest) for a, b, *rest in zip(k, width, low, high, marks, strict=True)], dtype="int64")


def _indexed(texts: DataFrame) -> DataFrame:
    return texts.withColumn("list", F.pandas_udf(_lists, LIST)(F.col("text").cast("binary")))


def with_lists(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, text, list) for rows (id, text) without null texts. ``digest`` need not tell texts apart: within a digest they are compared."""
    keyed = docs.select("id", "text", digest(F.col("text")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    bar = max(HOT_TEXT, docs.count() // MOST_HOT)
    hot = materialize(counts.where(F.col("n") > bar).select("key", F.ceil(F.col("n") / bar).cast("int").alias("pieces")), "fim-hot")
    hot = F.broadcast(hot)  # at most MOST_HOT keys

    # collect_set compares whole texts, in map tasks first
    texts = F.collect_set("text").alias("texts")
    rare = keyed.join(hot, "key", "left_anti").groupBy("key").agg(texts, F.collect_list(F.struct("id")).alias("members"))
    frequent = keyed.join(hot, "key", "left_semi").groupBy("key").agg(texts)

    def alone(groups):
        return groups.where(F.size("texts") == 1).withColumn("text", F.col("texts")[0]).drop("texts")

    parts = [_indexed(alone(rare)).withColumn("member", F.explode("members")).withColumn("id", F.col("member.id"))]
    # lists of frequent texts are copied to each piece of their documents
    dealt = keyed.select("id", "key").join(hot, "key").select("id", "key", F.pmod(F.monotonically_increasing_id(), F.col("pieces")).cast("int").alias("piece"))
    copies = _indexed(alone(frequent)).join(hot, "key").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    parts.append(dealt.hint("shuffle_hash").join(copies, ["key", "piece"]))
    # different texts of one digest are joined by the texts themselves; there is about one such pair in 6e9 documents. Members are read
    # so that both uses of the groups are of one shuffle, not of two that differ in their columns.
    for groups, used in ((rare, F.size("members") > 0), (frequent, F.lit(True))):
        clashing = groups.where((F.size("texts") > 1) & used).select("key", F.explode("texts").alias("text"))
        parts.append(keyed.join(F.broadcast(_indexed(clashing)), ["key", "text"]))
    first, *rest = (p.select("id", "text", "list") for p in parts)
    for part in rest:
        first = first.unionByName(part)
    return first


def fill_in_middle(docs: DataFrame, id_: str = "doc_id", text: str = "text", seed: str = "1", plain: int = 10, spm: int = 20, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The id with ``text``, n (its code points), form, prefix_chars, middle_chars and ``output`` of every row.

    Of the sha256 of seed, colon and id, the first two groups of 8 hex digits draw the cuts, the third the ``plain`` percent of texts left
    as they are, and the fourth the ``spm`` percent of the others whose suffix comes first. A null text is empty; empty texts and those
    that hold a sentinel stay plain, with null lengths. A null id is drawn as the empty string. Repeated rows give repeated rows; other
    columns take no part. An empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    rows = with_lists(docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), digest)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    n = F.col("list.n")
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((n == 0) | held | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("id", "text", "list", n.alias("n"), form.alias("form"), F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("k1"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("k2"))
    lists, at = [F.col(f"list.{x}") for x in _FIELDS[1:]], F.pandas_udf(_select, "long")
    rows = rows.select("id", "text", "n", "form", "k1", "k2", at("k1", *lists).cast("int").alias("a"), at("k2", *lists).cast("int").alias("b"))
    data, a, b = F.col("text").cast("binary"), F.col("a"), F.col("b")
    prefix, middle, suffix = F.substring(data, F.lit(1), a), F.substring(data, a + 1, b - a), F.substring(data, b + 1, F.octet_length("text") - b)
    p, s, m = (F.lit(x).cast("binary") for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(data)
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_), F.col("text").alias(text), "n", "form",
        F.when(cut, F.col("k1")).alias("prefix_chars"), F.when(cut, F.col("k2") - F.col("k1")).alias("middle_chars"), output.cast("string").alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; sentinels stand in an output of a cut text only where they were put."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM texts
), cut AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(t, 1, least(x, y)) AS prefix, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle,
    substr(t, greatest(x, y) + 1) AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END)
    AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
