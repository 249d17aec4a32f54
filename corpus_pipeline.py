"""A training corpus from ``documents``: language, near copies, repeated passages, mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.llm import language, mixing, packing, simhash, suffix
from evlake.llm.common import bounded_batches, held_out_rows
from evlake.llm.queries import tokenizer_path
from evlake.session import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; a text without a letter goes."""
    bounded_batches(spark)
    learn = F.col("doc_id").isNotNull() & ~held_out_rows(F.col("doc_id"), 4, 2)
    judged = language.predict(docs, language.fit(docs, learn))
    return judged.filter(~F.col("rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8."""
    bounded_batches(spark)
    return simhash.first_of_groups(docs, size=5)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 200 bytes or more."""
    bounded_batches(spark)
    return suffix.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the target of their source asks."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 ids."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path(), keep_words=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("mixing", mix),
    ("packing", pack),
]

# Language identification, suffix order and tokenization have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
