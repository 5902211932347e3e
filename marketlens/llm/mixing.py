"""Mixing sources to target weights by hash-threshold histograms.

Word counts are summed by (source, hash bucket); a running sum over the buckets of a source finds the one in which its budget ends,
and only the documents of that bucket are split by the next bits of the hash, until the threshold is exact. Documents are then
filtered by comparing their hash with their source's threshold. Nothing is sorted, and no task holds more than the histogram of a
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import broadcast_if_small, materialize

#: What separates words
WHITE_SPACE = r"[\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 10
#: Weights are dealt to the sources in code-point order, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Tables of one row per source are broadcast up to this many sources, and joined by a shuffle beyond.
BROADCAST_SOURCES = 50_000


def _key(source: Column) -> Column:
    """A source as a key that is never null and sorts null last: U+10FFFF is above any other first character."""
    return F.when(source.isNull(), F.lit("\U0010ffff")).otherwise(F.concat(F.lit("="), source.cast("string")))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source_key, source_size) -> those and ``target``.

    All words are shared by weight. A source whose share exceeds ``most`` times its size stops there and its excess is dealt again by
    weight. Capped sources are a prefix in the order of size / weight, so prefix sums give the level at which sharing ends. One row
    per source goes through one task. A corpus without words has targets 0.
    """
    by_name = Window.orderBy("source_key")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total, weight = F.sum("source_size").over(everything), F.sum("_w").over(everything)
    room = total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = weight - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # the level rises while sources are capped and falls as soon as one that should not be is
    levels = weighed.withColumn("_level", room / left)
    final = levels.withColumn("_final", F.max("_level").over(everything))
    target = F.least(F.col("_final") * F.col("_w"), (most * F.col("source_size")).cast("double"))
    return final.select("source_key", "source_size", target.alias("target"))


def _hash(doc_id: Column, text: Column) -> Column:
    """A number of HASH_BITS bits of id and text, so texts under one id or under none are chosen each for itself."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _repeats(h: Column) -> Column:
    """How often a document with this hash is taken, by its source's row of the plan."""
    at_most = F.coalesce("bar", F.lit((1 << HASH_BITS) - 1))
    return F.col("whole") + F.when((F.col("budget") > 0) & (h <= at_most), 1).otherwise(0)


def _plan(docs: DataFrame, weights: tuple[float, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and of each source its size, target, whole repeats, and the threshold for the rest."""
    parts = F.split(F.coalesce("text", F.lit("")), WHITE_SPACE)
    size = F.size(F.filter(parts, lambda w: w != "")).cast("long")
    sized = docs.select("doc_id", _key(F.col("source")).alias("source_key"), size.alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("h"))
    sized = materialize(sized, "mixing-sizes")
    sources = targets(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialize(sources.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mixing-sources")

    # the bucket of each source in which the budget ends: the hash's leading bits, and the words below it
    edge = sources.select("source_key", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"))
    inside, bits = sized, 0
    while bits < HASH_BITS:
        inside = inside.join(broadcast_if_small(edge, BROADCAST_SOURCES), "source_key").where(F.shiftright("h", HASH_BITS - bits) == F.col("bucket")) if bits else inside.join(broadcast_if_small(edge, BROADCAST_SOURCES), "source_key")
        bits += LEVEL_BITS
        buckets = inside.groupBy("source_key", "budget", "below", F.shiftright("h", HASH_BITS - bits).alias("next")).agg(F.sum("size").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"))
        running = F.col("below") + F.sum("n").over(Window.partitionBy("source_key").orderBy("next"))
        ends = buckets.withColumn("upto", running).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")) & (F.col("n") > 0))
        ends = materialize(ends.select("source_key", "budget", F.col("next").alias("bucket"), (F.col("upto") - F.col("n")).alias("below"), "upto", "least", "most"), "mixing-edge")
        edge = ends.select("source_key", "budget", "bucket", "below")
        inside = inside.select("source_key", "size", "h")
        if ends.where(F.col("least") < F.col("most")).limit(1).count() == 0:
            break

    # all hash values before the edge are taken, and the edge itself if that is nearer
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("below")
    bar = ends.select("source_key", F.when(nearer, F.col("least")).otherwise(F.col("least") - 1).alias("bar"))
    plan = sources.join(bar, "source_key", "left")
    plan = materialize(plan.select("source_key", "source_size", "target", "whole", "budget", "bar"), "mixing-plan")
    return sized, broadcast_if_small(plan, BROADCAST_SOURCES)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Every document with size, source_size, target and taken.

    A source is taken whole as often as its target allows, and the rest of its budget is met by the documents whose hash lies at or
    below its threshold; the hash value at which the budget ends is taken if that comes nearer to the target. The hash is that of id and
    text, so reruns agree, smaller budgets are contained in larger ones, and only rows that agree in both stand or fall together. Null
    texts have size 0 and are taken with 0 words; a null id hashes as the empty text; a null source is a source; an empty table gives an
    empty result. Other columns are ignored.
    """
    sized, plan = _plan(docs, weights, most)
    taken = (F.col("size") * _repeats(F.col("h"))).cast("long")
    return sized.join(plan, "source_key").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, all columns, and ``repeats``: how often each goes in. Nothing else is said of them than by
    ``mix``; a column of the same name is replaced."""
    _, plan = _plan(docs, weights, most)
    plan = plan.select(F.struct("whole", "budget", "bar").alias("_mix_plan"), F.col("source_key").alias("_mix_source"))
    joined = docs.join(plan, _key(F.col("source")) == F.col("_mix_source"))
    bar = F.coalesce("_mix_plan.bar", F.lit((1 << HASH_BITS) - 1))
    repeats = F.col("_mix_plan.whole") + F.when((F.col("_mix_plan.budget") > 0) & (_hash(F.col("doc_id"), F.col("text")) <= bar), 1).otherwise(0)
    return joined.withColumn("repeats", repeats.cast("int")).where(F.col("repeats") > 0).drop("_mix_plan", "_mix_source")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN chr(1114111) ELSE '=' || source END AS source_key,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15) AS h
  FROM documents),
sources AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / w, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source_key, source_size, least((SELECT max(level) FROM levels) * w, (3 * source_size)::DOUBLE) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
summed AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source_key ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto,
         sum(s.size) OVER (PARTITION BY s.source_key, s.h)::DOUBLE AS here
  FROM sized s JOIN plan p USING (source_key))
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND (upto <= budget OR (upto - here <= budget AND upto - budget < budget - (upto - here))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
