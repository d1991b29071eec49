"""Retry bookkeeping: what failed, what was tried, what recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.keys import last_by, union_all

KEY = ["model_id", "mode", "track", "benchmark_id"]


def latest(log: DataFrame, order: str = "ord") -> DataFrame:
    """The last result of each item."""
    return last_by(log, KEY, order)


def queue(cases: DataFrame, models: DataFrame, predictions: DataFrame, fallback: DataFrame, log: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Items (KEY, reason) without a prediction or with one that equals the fallback, unless recovered since.

    ``cases`` (track, benchmark_id), ``models`` (model_id, mode, track), ``predictions`` (KEY, record_key), ``fallback`` (track, benchmark_id, record_key).
    """
    wanted = models.join(cases, "track")
    spare = fallback.select("track", "benchmark_id", F.col("record_key").alias("fallback_key"))
    found = wanted.join(predictions, KEY, "left").join(spare, ["track", "benchmark_id"], "left")
    reason = F.when(F.col("record_key").isNull(), "missing_prediction").when(F.col("record_key") == F.col("fallback_key"), "fallback_prediction")
    out = found.select(*KEY, reason.alias("reason")).where("reason is not null")
    if log is not None:
        out = out.join(latest(log, order).where("retry_status = 'recovered'").select(*KEY), KEY, "left_anti")
    return out


def reconcile(log: DataFrame, valid: DataFrame, order: str = "ord") -> DataFrame:
    """Latest results, those that still failed set to recovered where a valid prediction is there by now."""
    now = latest(log, order)
    solved = now.where("retry_status = 'still_failed'").join(valid.select(*KEY).distinct(), KEY, "left_semi").withColumn("retry_status", F.lit("recovered"))
    rest = now.join(solved.select(*KEY), KEY, "left_anti")
    return union_all(rest, solved)


def summary(log: DataFrame, order: str = "ord") -> DataFrame:
    """(model_id, mode): recovered and still failed items, the latter by kind of error."""
    still = F.col("retry_status") == "still_failed"
    invalid = F.coalesce(F.col("error_type").contains("json"), F.lit(False))
    return latest(log, order).groupBy("model_id", "mode").agg(
        F.count(F.lit(1)).alias("retry_queue_size"),
        F.count_if(F.col("retry_status") == "recovered").alias("retry_recovered_count"),
        F.count_if(still).alias("retry_still_failed_count"),
        F.count_if(still & invalid).alias("post_retry_invalid_json_count"),
        F.count_if(still & ~invalid).alias("post_retry_api_error_count"),
    )


def chunk_size(df: DataFrame) -> DataFrame:
    """Cases a request: one for structures and poses, 25 for ranking panels, 50 else."""
    return df.withColumn("chunk_size", F.when(F.col("track").isin("pose", "structure"), 1).when(F.col("track") == "binding_rank", 25).otherwise(50))


def plan(items: DataFrame) -> DataFrame:
    """(model_id, mode, track, items, requests) of a queue."""
    counts = items.groupBy("model_id", "mode", "track").agg(F.count(F.lit(1)).alias("items"))
    return chunk_size(counts).withColumn("requests", F.ceil(F.col("items") / F.col("chunk_size"))).drop("chunk_size")
