"""The registered queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, mixing, near_dedup, packing, quality, sharding, token_counts, token_matrix, warc
from .common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir)).select("doc_id", "n_tokens")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(documents(spark, sf_dir)).drop("doc_hash")


def op4_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.read(token_matrix.write(documents(spark, sf_dir)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.apply(docs, *quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = warc.read(warc.write(warc.with_roles(pages)), with_payload=False)
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).withColumns({"target": F.round("target", 6), "position": F.round("position", 6)})


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.SQL, "op8_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL}
