"""Tables that change as a whole: versions beside each other, and a log that says which one counts.

A version is written by Spark's own committer into a new folder. It counts once
an entry of the next number is in ``_log``, put there by a rename that fails if
the number is taken. So a job that fails, or whose executors are lost for good,
leaves the table as it was; readers see one version or the next, never half of
one; and of two writers that began from the same version, one is refused. Files
are only reached through Spark and its file systems, wherever they lie.

Defined cases: a table without an entry doesn't exist (``read`` raises
``FileNotFoundError``, ``upsert`` writes the first version); an empty frame is a
version without rows; what a failed writer left is removed by it, and never read
if it couldn't be.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lectern.operators.keys import upsert as upserted

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer was first: the version that this one began from no longer counts."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202 - a Java object
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)


def _path(jvm, *parts: str):  # noqa: ANN001, ANN202
    return jvm.org.apache.hadoop.fs.Path("/".join(parts))


def version(spark: SparkSession, path: str) -> int:
    """Number of the version that counts, 0 where there is none."""
    jvm, fs, _ = _files(spark, path)
    log = _path(jvm, path, LOG)
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def _folder(spark: SparkSession, path: str, number: int) -> str:
    jvm, fs, _ = _files(spark, path)
    entry = fs.open(_path(jvm, path, LOG, f"{number:012d}"))
    try:
        return entry.readUTF()
    finally:
        entry.close()


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as it counts now, or as it was at a version."""
    number = version(spark, path) if number is None else number
    if number < 1:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(f"{path}/{_folder(spark, path, number)}")


def _written(df: DataFrame, path: str) -> str:
    """The folder of a new version that doesn't count yet; nothing is left of one that failed."""
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{path}/{folder}")
    except Exception:
        jvm, fs, _ = _files(spark, path)
        fs.delete(_path(jvm, path, folder), True)
        raise
    return folder


def _counts(spark: SparkSession, path: str, folder: str, number: int) -> int:
    """Put the entry in place, or refuse."""
    jvm, fs, context = _files(spark, path)
    ready = _path(jvm, path, LOG, f"entry-{uuid.uuid4().hex}")
    out = fs.create(ready)
    out.writeUTF(folder)
    out.close()
    try:
        context.rename(ready, _path(jvm, path, LOG, f"{number:012d}"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(ready, False)
        fs.delete(_path(jvm, path, folder), True)
        raise Conflict(f"version {number} of {path} exists") from e
    return number


def commit(df: DataFrame, path: str, since: int | None = None) -> int:
    """Write ``df`` as the next version and return its number; refused if ``since`` isn't the version that counts when it is done."""
    spark = df.sparkSession
    since = version(spark, path) if since is None else since
    return _counts(spark, path, _written(df, path), since + 1)


def change(spark: SparkSession, path: str, f: Callable[[DataFrame], DataFrame]) -> int:
    """The next version is ``f`` of the one that counts; refused if another came between."""
    since = version(spark, path)
    return commit(f(read(spark, path, since)), path, since)


def upsert(changes: DataFrame, path: str, keys: list[str]) -> int:
    """Rows of ``changes`` replace those of their keys and are appended where there are none, all or none of them."""
    spark = changes.sparkSession
    if not version(spark, path):
        return commit(changes, path, 0)
    return change(spark, path, lambda now: upserted(now, changes, keys))


def mirror(df: DataFrame, *paths: str) -> list[int]:
    """The same rows as the next version of several tables. All are written before the first one counts, so that a failing job changes none."""
    spark, since = df.sparkSession, [version(df.sparkSession, p) for p in paths]
    folders: list[str] = []
    try:
        for p in paths:
            folders.append(_written(df if not folders else spark.read.parquet(f"{paths[0]}/{folders[0]}"), p))
    except Exception:
        for p, folder in zip(paths, folders, strict=False):
            jvm, fs, _ = _files(spark, p)
            fs.delete(_path(jvm, p, folder), True)
        raise
    return [_counts(spark, p, folder, n + 1) for p, folder, n in zip(paths, folders, since, strict=True)]
