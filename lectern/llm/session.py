"""Session services shared by the operators: the checkpoint folder and partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.runtime import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one of our own where it is unset (tests, one machine)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(where)
        return where
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, light: bool = False) -> DataFrame:
    """Cut lineage through the shared folder: later stages survive the loss of any executor without rerunning what came before.

    Light frames have a few dozen bytes where documents have thousands: an
    eighth of the shuffle's partitions holds them, in as many files.
    """
    spark = df.sparkSession
    shared_dir(spark)
    return (df.coalesce(max(8, partitions(spark) // 8)) if light else df).checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors. Where it has Spark's default sizes, hand Python batches of 2,000 rows and 16 MB at most, so that texts weigh little beside a task's heap."""
    ship(spark)
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "64m"), "16m")):
        if spark.conf.get(key, default[0]) in default:
            spark.conf.set(key, value)
    return spark
