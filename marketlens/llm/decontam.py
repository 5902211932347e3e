"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every 6 consecutive 5-grams of words, the one with the smallest hash (the rightmost of equals) is a fingerprint, so any 10 words
that a document shares with an item share a fingerprint at the same place. Documents' fingerprints are joined with those of the
items' windows, and each match is extended to the window around it and compared word by word. Items of fewer than ten words are one
window, matched by a gram of their own length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import broadcast_if_small, materialize

WINDOW, GRAM = 10, 5
#: Windows of the benchmark are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_WINDOWS = 200_000
#: A fingerprint is one number: the hash's leading 36 bits, then the place counted down, so that the smallest is the rightmost.
_PLACE_BITS = 28
_LAST = (1 << _PLACE_BITS) - 1
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, _SEPARATORS), lambda w: w != "")


def _marked(gram: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(gram, _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.lit(_LAST).cast("long") - place)


def _grams(hashes: Column, n: Column, width: int, whole: bool) -> Column:
    """The marked hash of each gram of ``width`` words; grams that stand for whole short items hash apart from all others."""
    places = F.sequence(F.lit(0), n - width)
    return F.transform(places, lambda i: _marked(F.xxhash64(F.lit(width if whole else 0), *[F.get(hashes, i + j) for j in range(width)]), i))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: inside a lambda the optimizer does not copy it into each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fingerprints(all_words: Column, short: list[int]) -> Column:
    """The winnowed fingerprints of a text, and those of its grams as long as the short items are."""
    span = WINDOW - GRAM + 1

    def of_hashes(hashes: Column) -> Column:
        n = F.size(hashes)
        starts = F.sequence(F.lit(0), n - WINDOW)
        winnowed = _bind(_grams(hashes, n, GRAM, False), lambda grams: F.array_distinct(F.transform(starts, lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))))
        own = [F.when(n >= w, _grams(hashes, n, w, True)).otherwise(_none()) for w in short]
        return F.concat(F.when(n >= WINDOW, winnowed).otherwise(_none()), *own)

    return _bind(F.transform(all_words, lambda w: F.xxhash64(w)), of_hashes)


def windows(benchmark: DataFrame) -> DataFrame:
    """fp, offset, window (words) and items of each distinct window; a null item_id is named by the empty string."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("all"))
    items = items.where(F.size("all") > 0).withColumn("w", F.least(F.size("all"), F.lit(WINDOW)))
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("all") - F.col("w") + 1), lambda i: F.slice("all", i, F.col("w")))).alias("words"))
    each = each.groupBy("words").agg(F.collect_set("item").alias("items"))

    def mark(hashes: Column) -> Column:
        n = F.size(hashes)
        found = F.when(n == WINDOW, F.array_min(_grams(hashes, F.lit(WINDOW), GRAM, False)))
        for w in range(1, WINDOW):
            found = found.when(n == w, F.element_at(_grams(hashes, F.lit(w), w, True), 1))
        return found

    each = each.withColumn("mark", _bind(F.transform("words", lambda w: F.xxhash64(w)), mark))
    return each.select(F.shiftright("mark", _PLACE_BITS).alias("fp"), (F.lit(_LAST) - F.col("mark").bitwiseAND(F.lit(_LAST).cast("long"))).alias("offset"), F.col("words").alias("window"), "items")


def _hits(docs: DataFrame, benchmark: DataFrame, limit: int) -> DataFrame:
    """(doc_id, digest, n, start, stop, items) of each occurrence of a window, and a row without start for each document."""
    wins = materialize(windows(benchmark), "windows")
    short = [r["w"] for r in wins.select(F.size("window").alias("w")).distinct().where(F.col("w") < WINDOW).orderBy("w").collect()]  # 9 at most
    table = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    table = table.select("*", F.size("words").cast("long").alias("n"), _fingerprints(F.col("words"), short).alias("prints"))
    none = F.lit(None).cast("long")
    small = wins.limit(limit + 1).count() <= limit
    start = F.lit(_LAST) - F.col("print").bitwiseAND(F.lit(_LAST).cast("long")) - F.col("offset")
    same = (F.col("start") >= 0) & (F.slice("words", F.greatest(F.col("start") + 1, F.lit(1)).cast("int"), F.size("window")) == F.col("window"))
    if small:
        # one pass over the documents: a null among the fingerprints stands for the document itself
        rows = table.select("doc_id", "digest", "n", "words", F.explode(F.concat(F.array(none), F.col("prints"))).alias("print"))
        rows = rows.withColumn("fp", F.shiftright("print", _PLACE_BITS)).join(F.broadcast(wins), "fp", "left").withColumn("start", start)
        rows = rows.where(F.col("print").isNull() | same)
    else:
        marks = table.select("doc_id", "digest", F.explode("prints").alias("print")).withColumn("fp", F.shiftright("print", _PLACE_BITS))
        found = marks.join(wins, "fp").withColumn("start", start).select("doc_id", "digest", "start", "window", "items")
        found = materialize(found.where(F.col("start") >= 0), "window-marks")
        # the words of documents with a mark only, each once
        met = broadcast_if_small(materialize(found.select(F.col("doc_id").alias("_met"), F.col("digest").alias("_met_digest")).distinct(), "window-documents"), limit)
        texts = table.join(met, F.col("doc_id").eqNullSafe(F.col("_met")) & (F.col("digest") == F.col("_met_digest")), "left_semi")
        texts = texts.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "words", "n").dropDuplicates(["_id", "_digest"])
        found = found.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).where(same)
        own = table.select("doc_id", "digest", "n", none.alias("start"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
        rows = found.select("doc_id", "digest", "n", "start", "window", "items").unionByName(own)
    return rows.select("doc_id", "digest", "n", "start", (F.col("start") + F.size("window")).alias("stop"), "items")


def report(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    A word is hit if it lies in any occurrence of a window of the benchmark. Null and empty texts have no words and are clean, with
    the digest of the empty list; rows that agree in doc_id and text give equal rows, as many as there are; a null doc_id is kept; an
    empty benchmark leaves all clean. Only doc_id, text and item_id are read, so other columns cannot clash.
    """
    hits = _hits(docs, benchmark, broadcast_windows)
    whole = F.col("start").isNull()
    grouped = hits.groupBy("doc_id", "digest").agg(
        F.max("n").alias("n_words"),
        F.count_if(whole).alias("copies"),
        F.collect_set(F.when(~whole, F.struct("start", "stop"))).alias("spans"),
        F.collect_set("items").alias("item_lists"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        F.sort_array("spans"),
        zero,
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["upto"]))).alias("hit"),
            F.greatest(acc["upto"], s["stop"]).alias("upto"),
        ),
        lambda acc: acc["hit"],
    )
    out = grouped.withColumn("items", F.sort_array(F.array_distinct(F.flatten("item_lists")))).withColumn("n_hit", covered)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of the benchmark occurs in."""
    hits = _hits(docs, benchmark, broadcast_windows).where(F.col("start").isNotNull())
    dirty = hits.select(F.col("doc_id").alias("_dirty_id"), F.col("digest").alias("_dirty_digest")).distinct()
    dirty = broadcast_if_small(materialize(dirty, "contaminated"), 1_000_000)
    on = F.col("_kept.doc_id").eqNullSafe(F.col("_dirty_id")) & (F.xxhash64(F.col("_kept.text")) == F.col("_dirty_digest"))
    return docs.alias("_kept").join(dirty, on, "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bk AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bk)),
widths AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, widths WHERE len(w) >= k)),
m AS (SELECT DISTINCT rid, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
