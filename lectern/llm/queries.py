"""The queries op1 to op10 over the driver's tables: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import clusters, decontaminate, fingerprint, licenses, merkle, near, packing, ppm, quality, repeats, reputation, secrets, shards
from lectern.llm.session import ready

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards_below_shared(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_token_shards": op1_token_shards,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_reputation": op5_url_reputation,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm_scores": op7_lm_scores,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": near.near_duplicates_sql(), "op4_suffix_dedup": repeats.remove_repeats_sql(), "op5_url_reputation": reputation.judge_urls_sql(), "op11_license_scan": licenses.report_sql(), "op12_merkle_manifest": merkle.verified_sql(), "op13_centroid_clusters": clusters.clustered_sql()}
