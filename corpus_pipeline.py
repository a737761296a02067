"""A training corpus from raw documents, in five stages.

1. ``language``: texts without a letter go, and those whose main language makes up less than a third.
2. ``near``: one document of each class of near duplicates stays.
3. ``decontaminate``: documents with benchmark passages go.
4. ``mix``: sources are brought to their weights: documents of a source above its target are left
   out, those of one below are repeated, whole, up to three times; rows come in training order.
5. ``shard``: rows are dealt at random into shards of equal size (``shard``, ``slot`` are added).

Every stage works on all rows of the one before, is written as Parquet to the shared folder and
read again. All but the last return the columns of ``documents``. Nulls in any column, empty and
long texts, repeated rows, empty tables and further columns are handled by the operators; each
states how. Language models need SQL-foreign iteration, so there is no oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontaminate, language_id, mixing, near_dedup, sharding
from spoor.llm.common import read_table, store

N_SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, model)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, mixing.cycled_schedules)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, N_SHARDS)


STAGES = [
    ("language", language),
    ("near", near),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
