"""A corpus pipeline of five stages, each an operator of ``tesserae.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.codec import encode_documents
from tesserae.llm.minhash import dedup_documents
from tesserae.llm.mixing import mix_documents
from tesserae.llm.quality import with_quality
from tesserae.llm.shared import free_name, materialize
from tesserae.llm.toxicity import with_toxicity

#: A document goes if its toxicity reaches this, or its quality stays below that.
TOXIC, GOOD = 0.3, 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches TOXIC."""
    name = free_name(docs.columns, "score")
    return with_toxicity(docs, _labels(spark, sf_dir), held_out=None, score_col=name).filter(F.col(name) < TOXIC).drop(name)


def remove_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose quality score stays below GOOD."""
    name = free_name(docs.columns, "score")
    return with_quality(docs, _labels(spark, sf_dir), held_out=None, score_col=name).filter(F.col(name) >= GOOD).drop(name)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and what they decode to."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality classifier", remove_poor),
    ("minhash near-dedup", remove_copies),
    ("mixing to target weights", mix),
    ("sentencepiece encoding", encode),
]

#: Learnt scores and Viterbi paths have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
