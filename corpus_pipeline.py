"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing; each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; each result is written as Parquet to the
shared folder and read again, so a stage that loses executors starts from its predecessor's table. Operators are imported where a
stage runs, so that this module's list of stages can be read without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from chronoloom.llm import quality

    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from chronoloom.llm import line_dedup

    return line_dedup.dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from chronoloom.llm import near_dedup

    return near_dedup.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from chronoloom.llm import mixing

    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from chronoloom.llm import packing

    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trees, the sampling and the differencing; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.llm.common import documents, save

    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
