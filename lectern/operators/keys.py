"""Keyed operators: deduplication by order, missing keys, upserts and ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Adds the order of the rows, unless the table has it: by file, place of the split in the file, row in the split.

    Spark packs splits into tasks by size, so a row number alone doesn't follow
    the files. Tables that aren't read from files have their row number.
    """
    if name in df.columns:
        return df
    row = F.monotonically_increasing_id()
    try:
        placed = df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", row.alias("row")).alias(name))
        placed.schema  # analysed here
        return placed
    except AnalysisException:
        return df.withColumn(name, row)


def _pick(df: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def first_by(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row a key: the first in order. Combined before the shuffle, so a hot key costs a row a task."""
    return _pick(df, keys, order, last=False)


def last_by(df: DataFrame, keys: list[str], order: str = "ord", keep_place: bool = False) -> DataFrame:
    """One row a key: the last in order; with ``keep_place`` its order is that of the key's first row."""
    out = _pick(df, keys, order, last=True)
    if not keep_place:
        return out
    places = df.groupBy(*keys).agg(F.min(order).alias("_place"))
    return out.drop(order).join(places, keys).withColumnRenamed("_place", order).select(*df.columns)


def record_id(df: DataFrame) -> Column:
    """benchmark_id, or source_id where there is none."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("benchmark_id", "source_id") if c in df.columns])


def deduplicate_records(df: DataFrame, order: str = "ord") -> DataFrame:
    """First record of each id; records without any id all stay."""
    keyed = df.withColumn("_id", record_id(df))
    return first_by(keyed.where("_id is not null"), ["_id"], order).drop("_id").unionByName(keyed.where("_id is null").drop("_id"))


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``other`` lacks."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def ordered_like(df: DataFrame, cases: DataFrame, key: str = "benchmark_id", order: str = "ord") -> DataFrame:
    """Rows of known keys, in the order of ``cases``."""
    return df.drop(order).join(cases.select(key, order), key).orderBy(order)


def upsert(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` replaces the rows of its keys and is appended where there are none."""
    return without(df, changes, keys).unionByName(changes, allowMissingColumns=True)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def chunks(df: DataFrame, order: str, size: int, *by: str) -> DataFrame:
    """Adds ``chunk``: consecutive rows of each group in groups of ``size``."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def unique_notes(*arrays: Column) -> Column:
    """Distinct members of the arrays, first appearances in order."""
    return F.array_distinct(F.concat(*arrays))


def duplicates_by_hash(df: DataFrame, text: str, key: str) -> DataFrame:
    """(sha256, n, first_key) of the texts that occur more than once."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).where("n > 1")
