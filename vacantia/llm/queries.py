"""The registered queries of this folder. Each is thin: tables in, operator, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import (
    chat,
    collocations,
    decontaminate,
    jaccard,
    language,
    line_dedup,
    mixing,
    personal_data,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("items")


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.rate(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.summary(personal_data.find(_table(spark, folder, "documents")))


@query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.summary(secrets.scan(_table(spark, folder, "documents")))


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_by_source(_table(spark, folder, "documents"))


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


@query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.group(_table(spark, folder, "documents")).drop("class", "component")


@query
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.link(chat.with_reply_calls(_table(spark, folder, "conversations")), chat.REPLY)


@query
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.summary(line_dedup.without_repeated_lines(_table(spark, folder, "documents")))


ORACLES["op12_line_dedup"] = line_dedup.ORACLE


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


@query
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


ORACLES["op11_phrase_mining"] = collocations.ORACLE
