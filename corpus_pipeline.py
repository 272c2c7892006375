"""The corpus pipeline: each stage reads what the one before wrote; run() applies them to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontamination, language_id, mixing, near_duplicates, token_shards
from tallyloom.llm.common import cut, documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.language_stage(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates_stage(spark, docs, sf_dir)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate_stage(spark, docs, sf_dir)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_stage(spark, docs, sf_dir)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.tokens_stage(spark, docs, sf_dir)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: Viterbi, components and the tokenizer can't be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
