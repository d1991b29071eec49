"""Result logs as streams: latest result by key, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_results(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key so far (update or complete mode): state is one row a key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once, however often a writer repeats it within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def event_counts(stream: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "1 day", *by: str) -> DataFrame:
    """(window_start, by, n, total) of tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")
