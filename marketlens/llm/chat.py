"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation again and again, each time with a few more turns. A rolling hash of every conversation's turn
prefixes tells which conversations are the beginning of a longer one; an anti-join keeps the maximal ones, of equal ones the one with
the smallest id, and only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and text of each maximal conversation.

    Turns are ordered by turn, then role and text, so ties have one order; a null turn comes first; repeated rows are turns of their
    own; a null role or text is the empty string; rows without a conv_id belong to no conversation and are left out; an empty table
    gives an empty result. The template's marker ``<|`` is written ``< |`` where a role or text contains it. A conversation becomes
    one row, so its turns meet in one task.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("pos", F.row_number().over(by_turn)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    # two 64-bit sums over the turns so far, each turn hashed with its place
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    one, two = F.xxhash64("pos", "role", "text"), F.xxhash64("text", "role", F.col("pos") + 1)
    hashed = placed.select("conv_id", "pos", "n", F.bit_xor(one).over(so_far).alias("h1"), F.bit_xor(two).over(so_far).alias("h2"))
    whole = hashed.where(F.col("pos") == F.col("n")).groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = hashed.where(F.col("pos") < F.col("n")).select(F.col("pos").alias("n"), "h1", "h2").distinct()
    kept = whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))

    def plain(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    shown = F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))), lambda t: F.concat(F.lit(OPEN), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(CLOSE + "\n")))
    texts = placed.select("conv_id", "pos", "role", "text").join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.array_join(shown, "").alias("text"))
    return texts.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "text")


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, pos, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
