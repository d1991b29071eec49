"""Reproducibility hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def record_hash(columns: list[str], drop: tuple[str, ...] = ("processed_record_hash",)) -> Column:
    """SHA-256 of the record's canonical JSON (fields by name, nulls left out) without its own hash."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns) if c not in drop])), 256)


def source_hash(database: Column, source_id: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (database, source_id, url)]), 256)


def with_hashes(df: DataFrame) -> DataFrame:
    """A missing source hash is filled, the processed hash is always renewed."""
    own = source_hash(F.col("source_database"), F.col("source_id"), F.col("source_url"))
    df = df.withColumn("source_record_hash", F.coalesce(F.nullif(F.col("source_record_hash"), F.lit("")), own))
    return df.withColumn("processed_record_hash", record_hash(df.columns))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files at a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def utc_now(at: Column | None = None) -> Column:
    """Seconds in UTC with Z; pass a timestamp where results must repeat."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
