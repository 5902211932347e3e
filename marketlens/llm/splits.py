"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int, limit: int) -> DataFrame:
    """(text, y, spot) of at most about ``limit`` labelled documents whose remainder modulo ``held_out`` is not 0.

    Rows are taken by a hash of the id against a threshold set from the count of the eligible labels, so the sample is even over the
    corpus, the same in each run, and no larger at any input size. ``spot`` deals copies of a text apart. A row that is repeated counts
    once; where ids with very many texts make the sample too large, it is thinned by a hash of id and text. Labels that are null or
    disagree for an id are averaged and rounded; a document with a null id is never learnt from.
    """
    key = F.col("doc_id")

    def hash_(*x):
        return F.pmod(F.xxhash64(*x), F.lit(1 << 31))

    known = labels.where(key.isNotNull() & F.col(label).isNotNull()).where(remainder(key, held_out) != 0)
    known = known.groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    eligible = known.count()
    bar = int(min(1.0, limit / max(1, eligible)) * (1 << 31))
    known = F.broadcast(known.where(hash_(key.cast("string")) <= bar))  # at most about `limit` rows
    near = docs.where(hash_(key.cast("string")) <= bar).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = materialize(near.join(known, "doc_id").dropDuplicates(["doc_id", "text"]), "labelled")
    rows = some.count()
    if rows > 2 * limit:
        some = some.where(hash_(key.cast("string"), "text") <= int(limit / rows * (1 << 31)))
    return some.select("text", "y", F.xxhash64(F.col("doc_id").cast("string"), F.lit("spot")).alias("spot"))
