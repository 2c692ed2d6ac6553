"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

language_id          drops texts whose language is rejected (no letters, or unlike every language)
ngram_join           keeps the smallest doc_id of each group of near-duplicates (five-word shingles, 0.8)
decontaminate        cuts benchmark passages; drops texts that are mostly such passages
secret_scan          replaces secrets by a mark
byte_bpe             encodes and decodes; gives doc_id, counts and digests

All stages but the last return the columns of ``documents``, extra ones with any names too. Null and
empty texts go with the language stage. Of near-duplicates and ties the smallest doc_id stays; rows
with the same doc_id are one document and stay or go together; a null doc_id is linked with nothing. Long
texts are read whole. An empty table gives no rows; an empty benchmark cuts nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspan.llm import byte_bpe, decontaminate, language_id, ngram_join, secret_scan
from fieldspan.llm.shared import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(language_id.trained_on(docs)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, n=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("ngram_join", deduplicate),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", redact),
    ("byte_bpe", encode),
]

#: SQL can't express the language models, the shingle join's components or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
