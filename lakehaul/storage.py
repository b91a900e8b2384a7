"""The few folder calls that DataFrame readers and writers do not offer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# What Spark takes for the size of a table that it does not know.
UNKNOWN_BYTES = (1 << 63) - 1


def _open(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    files, path = _open(spark, folder)
    return files.exists(path)


def is_empty(spark: SparkSession, folder: str) -> bool:
    """True if the folder is missing or holds nothing."""
    files, path = _open(spark, folder)
    return not files.exists(path) or not files.listStatusIterator(path).hasNext()


def make_folder(spark: SparkSession, folder: str) -> None:
    """Creates the folder if it is missing."""
    files, path = _open(spark, folder)
    files.mkdirs(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    files, path = _open(spark, folder)
    files.delete(path, True)


def swap_in(spark: SparkSession, fresh: str, folder: str) -> None:
    """Gives a written folder the name of another one, which is deleted afterwards.

    Two renames: cheap on a file system, a copy of the data on an object store.
    """
    files, path = _open(spark, folder)
    _, fresh_path = _open(spark, fresh)
    _, aside = _open(spark, f"{folder}.old-{uuid.uuid4().hex}")
    replaced = files.exists(path)
    if replaced and not files.rename(path, aside):
        raise OSError(f"cannot move {folder}")
    if not files.rename(fresh_path, path):
        if replaced:
            files.rename(aside, path)
        raise OSError(f"cannot move {fresh} to {folder}")
    if replaced:
        files.delete(aside, True)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Size of all files below a folder; 0 if it is missing."""
    files, path = _open(spark, folder)
    return files.getContentSummary(path).getLength() if files.exists(path) else 0


def plan_bytes(df: DataFrame) -> int | None:
    """Spark's estimate of the size of a frame, in bytes; ``None`` where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < UNKNOWN_BYTES else None


def same_folder(spark: SparkSession, left: str, right: str) -> bool:
    """Compares two folders after adding the file system each one defaults to."""
    (left_files, left_path), (right_files, right_path) = _open(spark, left), _open(spark, right)
    return left_files.makeQualified(left_path).equals(right_files.makeQualified(right_path))


def fresh_folder(spark: SparkSession, base: str | None = None) -> str:
    """Name of a new folder that every executor can reach.

    The base is the folder of ``spark.checkpoint.dir``, or where that is unset the
    session's warehouse folder.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lakehaul-{uuid.uuid4().hex}"
