"""Versions: whole changes, failed jobs, conflicts and mirrors."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.sinks import snapshots


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def seen(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_are_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.upsert(table(spark, [(1, "a"), (2, "b")]), path, ["k"]) == 1
    old = snapshots.read(spark, path)
    assert snapshots.upsert(table(spark, [(2, "B"), (3, "c")]), path, ["k"]) == 2
    assert seen(snapshots.read(spark, path)) == [(1, "a"), (2, "B"), (3, "c")]
    assert seen(old) == seen(snapshots.read(spark, path, 1)) == [(1, "a"), (2, "b")]
    assert snapshots.commit(table(spark, []), path) == 3 and seen(snapshots.read(spark, path)) == []


def test_a_failing_task_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(table(spark, [(1, "a")]), path)
    before = sorted(os.listdir(path))
    broken = spark.range(100).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("v"))
    for attempt in (lambda: snapshots.upsert(broken, path, ["k"]), lambda: snapshots.mirror(broken, path, str(tmp_path / "u"))):
        with pytest.raises(PySparkException):
            attempt()
        assert seen(snapshots.read(spark, path)) == [(1, "a")] and snapshots.version(spark, path) == 1 and sorted(os.listdir(path)) == before
    assert snapshots.version(spark, str(tmp_path / "u")) == 0


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.commit(table(spark, [(1, "a")]), path)

    def slow(now):
        snapshots.upsert(table(spark, [(5, "other")]), path, ["k"])
        return now.withColumn("v", F.lit("mine"))

    with pytest.raises(snapshots.Conflict):
        snapshots.change(spark, path, slow)
    assert seen(snapshots.read(spark, path)) == [(1, "a"), (5, "other")] and len([f for f in os.listdir(path) if f.startswith("v-")]) == 2


def test_mirrors(spark, tmp_path):
    paths = [str(tmp_path / n) for n in "abc"]
    snapshots.commit(table(spark, [(9, "z")]), paths[1])
    assert snapshots.mirror(table(spark, [(1, "a")]), *paths) == [1, 2, 1]
    assert all(seen(snapshots.read(spark, p)) == [(1, "a")] for p in paths)
