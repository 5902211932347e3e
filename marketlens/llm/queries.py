"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, decontam, fim, html, langid, licenses, lm, mixing, ngram_join, quality, toxicity
from .splits import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(modulus: int, rest: int = 0):
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).select("doc_id", _held_out(5), "score", "predicted")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_read(spark, sf_dir, "documents"), passes=1)
    return scored.select("doc_id", _held_out(10), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_read(spark, sf_dir, "conversations"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    params = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, params).select("doc_id", _held_out(5), "score", "predicted")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents")).drop("a", "b")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_ann": op3_ann,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_decontam": op7_decontam,
    "op8_langid": op8_langid,
    "op9_html": op9_html,
    "op10_ngram_join": op10_ngram_join,
    "op11_licenses": op11_licenses,
    "op12_alignment": op12_alignment,
    "op13_fim": op13_fim,
}
ORACLE_SQL: dict[str, str] = {"op4_chat": chat.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op7_decontam": decontam.ORACLE_SQL, "op10_ngram_join": ngram_join.ORACLE_SQL, "op13_fim": fim.ORACLE_SQL}
