"""A training-data pipeline over ``documents``: toxic documents go, one of each group of near copies stays, documents with benchmark text
go, sources are mixed to their weights, and the result is dealt to shards.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; it is written as Parquet into
the shared folder and read again for the next one. All stages but the last return the columns of ``documents``; the last adds ``shard``.
Null texts and ids pass through: a null text is not toxic, has no near copies and no benchmark text, but is never taken into the mix, as it
has no words. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import decontaminate, mix_sources, ngram_join, slot_shards, toxicity
from fieldspark.llm.common import stored, table
from fieldspark.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.first_of_groups(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mix_sources.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return slot_shards.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_benchmark_text),
    ("mix_sources", mix),
    ("slot_shards", shard),
]

#: Not expressible in SQL: the first stage trains a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
