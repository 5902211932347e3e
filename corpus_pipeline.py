"""From raw documents to a training mix, in stages that each write a table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared checkpoint
folder and gives the table read from there to the next stage. All stages but the last return the columns of ``documents``; the last
adds ``repeats``, how often a document goes into the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.cluster import ship
from marketlens.llm import decontam, langid, mixing, ngram_join, quality
from marketlens.llm.store import discard, materialize, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; texts that are null or without letters, or torn between languages, go. Rows are judged by
    their text alone, so repeated rows and null ids stay or go like others; nothing is left of an empty table."""
    ship(spark)
    return langid.keep_known(docs, langid.train(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality model, learnt from the labels of these documents, does not reject. Rows are judged by their text
    alone; a null text counts as empty; without labels the model is its start values."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies: five-word shingles, Jaccard similarity 0.8 or more. The smallest id
    stays, a null id only where the group has no other; of rows that agree in id and text one stays; texts without words all stay."""
    ship(spark)
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark; null and empty texts have none, and an empty benchmark leaves all."""
    ship(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that the sources come near their target weights, and adds ``repeats``. Null sources are one source; null and
    empty texts go in where their source's share admits them."""
    ship(spark)
    return mixing.take(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
]

#: Two stages learn their decisions, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and its input, are deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
