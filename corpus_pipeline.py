"""From raw documents to token ids: five stages, each one operator of ``tessera.llm``.

Every stage takes what its predecessor wrote and returns documents (the last one token ids).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import ship
from tessera.llm import (
    decontamination,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    simhash_dedup,
    tokenizer_files,
)
from tessera.llm.common import bound_batches, read_table
from tessera.plans.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _prepared(step: Stage) -> Stage:
    """The stage in a session whose workers have the package and bounded batches."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        bound_batches(spark)
        return step(spark, docs, sf_dir)

    return run


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def _dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def _redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(docs, tokenizer_files.PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _prepared(_quality)),
    ("simhash_dedup", _prepared(_dedup)),
    ("decontamination", _prepared(_decontaminate)),
    ("secret_scan", _prepared(_redact)),
    ("sentencepiece", _prepared(_encode)),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    *first, (name, last) = STAGES
    for step, function in first:
        docs = stage(function(spark, docs, sf_dir), step)
    return stage(last(spark, docs, sf_dir), name)
