"""Positions and running sums in a total order, over range bounds that are drawn once.

A sample of the keys is sorted and some of them become bounds. From then on the
bounds are constants of the plan: every pass finds a row's bucket by the same
binary search, so counting rows and numbering them can't disagree, whatever
columns, partitions or plans a pass has. Counting moves a row a bucket and task;
only numbering shuffles rows, once.

Defined cases: nulls come first; rows equal in ``order`` share a bucket and have
neighbouring positions in any order, so that a total order should be given where
ties are many; an empty table gives no rows; other columns are kept whatever
their names, unless they begin with ``_ordering``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

SAMPLED, MOST_SAMPLED = 64, 1 << 17  # keys sampled a bucket, and in all beyond eight a bucket
BUCKET = "_ordering_bucket"


def _key(order: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order])


def _constant(texts: list[str], kind: DataType) -> Column:
    """JSON texts of ``kind`` as one array, which the optimizer folds to a literal."""
    return F.from_json(F.lit(f"[{','.join(texts)}]"), ArrayType(kind))


def draw_bounds(df: DataFrame, order: list[str], parts: int) -> Column:
    """At most parts - 1 keys in order as a constant, from a sample of bounded size that Spark sorts. JSON may cut a key short (fractions of seconds), which leaves it a bound."""
    keys = df.select(_key(order).alias("k"))
    n, want = keys.count(), parts * max(8, min(SAMPLED, MOST_SAMPLED // parts))
    found = (keys if n <= want else keys.sample(want / n, seed=parts)).orderBy("k").select(F.to_json("k")).collect()
    return _constant([found[len(found) * i // parts][0] for i in range(1, parts)] if found else [], keys.schema["k"].dataType)


def bucketed(df: DataFrame, order: list[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """(df with its bucket, number of buckets): the bucket is how many bounds a key has at or below it."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, key = draw_bounds(df, order, parts), _key(order)
    steps = F.array(*[F.lit(1 << b) for b in range((parts - 1).bit_length() - 1, -1, -1)] or [F.lit(1)])
    return df.withColumn(BUCKET, F.aggregate(steps, F.lit(0), lambda at, h: at + F.when(F.get(bounds, at + h - 1) <= key, h).otherwise(0))), parts


def running(df: DataFrame, order: list[str], name: str, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` (1 where not given) over the rows before a row. Rows lie in order within their partitions, a bucket each.

    A sum for each bucket comes to the driver and goes back as a constant.
    """
    weight = F.lit(1) if weight is None else weight
    placed, parts = bucketed(df.withColumn("_ordering_weight", weight.cast("long")), order, parts)
    sums = {r[0]: r[1] for r in placed.groupBy(BUCKET).agg(F.sum("_ordering_weight")).collect()}
    before = F.lit([0, *itertools.accumulate(sums.get(b, 0) for b in range(parts))]).cast("array<long>")
    w = Window.partitionBy(BUCKET).orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_ordering_weight").over(w), F.lit(0))
    return placed.repartitionById(parts, F.col(BUCKET)).withColumn(name, inside + F.get(before, F.col(BUCKET))).drop(BUCKET, "_ordering_weight")


def positions(df: DataFrame, order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """0-based position of each row in a total order; 0 to n - 1, each once."""
    return running(df, order, name, None, parts)


def positions_within(df: DataFrame, by: str, order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """0-based position of each row among those that share ``by`` (not null), in the order of ``order``, however many share it."""
    return running_within(df, by, order, name, None, parts)


def running_within(df: DataFrame, by: str, order: list[str], name: str, weight: Column | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` (1 where not given) over the rows before a row among those that share ``by`` (not null), however many share it.

    Rows are placed by (by, order). Only a bucket's first group can begin in a
    bucket before it; what of it lies there is found from the first and last
    groups of the buckets, a row each, on the driver.
    """
    weight = F.lit(1) if weight is None else weight
    placed, parts = bucketed(df.withColumn("_ordering_weight", weight.cast("long")), [by, *order], parts)
    group = F.col(f"`{by}`")
    sizes = placed.groupBy(BUCKET, group.alias("g")).agg(F.sum("_ordering_weight").alias("n"))
    ends = sizes.groupBy(BUCKET).agg(F.to_json(F.struct(F.min("g").alias("g"))).alias("first"), F.to_json(F.struct(F.max("g").alias("g"))).alias("last"), F.max_by("n", "g").alias("n"))
    edges = {r[0]: r for r in ends.collect()}
    groups, before, last, held = [], [], None, 0
    for b in range(parts):
        edge = edges.get(b)
        goes_on = edge is not None and edge.first == last
        groups.append(edge.first if goes_on else "{}")
        before.append(held if goes_on else 0)
        if edge:
            held = edge.n + (held if goes_on and edge.first == edge.last else 0)
            last = edge.last
    begun = F.get(_constant(groups, StructType([StructField("g", df.schema[by].dataType)])), F.col(BUCKET))["g"]
    w = Window.partitionBy(BUCKET, group).orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(group == begun, F.get(F.lit(before).cast("array<long>"), F.col(BUCKET))).otherwise(0)
    inside = F.coalesce(F.sum("_ordering_weight").over(w), F.lit(0))
    return placed.repartitionById(parts, F.col(BUCKET)).withColumn(name, inside + carried).drop(BUCKET, "_ordering_weight")
