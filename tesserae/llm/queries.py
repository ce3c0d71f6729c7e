"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, mixing


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_score

    return lm_score(_read(spark, sf_dir, "documents"))


def op2_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq import similar_vectors

    return similar_vectors(_read(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codec import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), width=4)


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, format_conversations, with_added

    return digest(format_conversations(with_added(spark, _read(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_itq_dedup": op2_itq_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_hnsw": op5_hnsw,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
}

ORACLES: dict[str, str] = {"op7_mixing": mixing.ORACLE, "op10_chat_format": chat_format.ORACLE}
