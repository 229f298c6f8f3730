"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolake.llm import decontam, fingerprint, langid, licenses, linededup, mixing, pii, secrets, sharding, simhash
from chronolake.runtime import table


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


def op3_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, radius=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_iblt_fingerprints": op1_iblt_fingerprints,
    "op2_license_signatures": op2_license_signatures,
    "op3_trigram_secrets": op3_trigram_secrets,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_weak_supervision_pii": op5_weak_supervision_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_subword_langid": op7_subword_langid,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_feistel_sharding": op9_feistel_sharding,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {"op4_poisson_mixing": mixing.ORACLE_MIX}
