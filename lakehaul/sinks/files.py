from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehaul.names import quote
from lakehaul.operators.counts import WRITTEN, CountedWrite, CountLost
from lakehaul.sources.files import read_folder
from lakehaul.storage import (
    delete_folder,
    folder_exists,
    is_empty,
    make_folder,
    plan_bytes,
    swap_in,
)


def sized(
    df: DataFrame,
    file_bytes: int,
    partition_by: Sequence[str] = (),
    input_bytes: int | None = None,
) -> DataFrame:
    """The rows dealt out so that a write makes files of about ``file_bytes``.

    One shuffle, whose width is the size of the input over that of a file.  With partition
    columns the rows of a partition come together, and adaptive execution divides what is
    too large for a task, so a partition that holds a third of all rows is written by many.
    ``input_bytes`` is needed where Spark does not know the size of the input, as with a
    partitioned table of the session catalog.
    """
    known = plan_bytes(df) if input_bytes is None else input_bytes
    if known is None:
        raise ValueError("the size of the input is not known: give input_bytes")
    files = max(1, math.ceil(known / file_bytes))
    if not partition_by:
        return df.repartition(files)
    return df.hint("rebalance", files, *[F.col(quote(column)) for column in partition_by])


def write_folder(df: DataFrame, path: str, file_bytes: int | None = None, **options) -> int:
    """Writes a new Parquet folder and returns the number of rows written.

    A folder that exists is refused.  A failed write leaves no empty folder behind,
    so that it can be tried again.  ``file_bytes`` deals the rows to files of about
    that size; without it nothing is shuffled.
    """
    spark = df.sparkSession
    existed = folder_exists(spark, path)
    counted = CountedWrite(sized(df, file_bytes) if file_bytes else df)
    try:
        counted.rows.write.mode("errorifexists").options(**options).parquet(path)
    except Exception:
        if not existed and is_empty(spark, path):
            delete_folder(spark, path)
        raise
    try:
        return counted.count()
    except CountLost:
        # The folder is new, so its files hold these rows and no others.
        return read_folder(spark, path, df.schema).count()


def write_divided(df: DataFrame, path: str, condition: Column, name: str) -> tuple[int, int]:
    """Writes a new Parquet folder with one folder for each outcome of ``condition`` in it.

    Returns the rows for which it is false or null, and those for which it is true.  One pass
    writes and counts both; each folder exists even if no row went there.
    """
    spark = df.sparkSession
    flag = F.coalesce(condition, F.lit(False))
    counted = CountedWrite(df.withColumn(name, flag), extra=[F.count_if(flag).alias("lakehaul_true")])
    counted.rows.write.mode("errorifexists").partitionBy(name).parquet(path)
    folders = [divided_folder(path, name, outcome) for outcome in (False, True)]
    for folder in folders:
        make_folder(spark, folder)
    try:
        measured = counted.measured()
        return measured[WRITTEN] - measured["lakehaul_true"], measured["lakehaul_true"]
    except CountLost:
        return tuple(read_folder(spark, folder, df.schema).count() for folder in folders)


def divided_folder(path: str, name: str, outcome: bool) -> str:
    """Where ``write_divided`` puts the rows of one outcome."""
    return f"{path.rstrip('/')}/{name}={str(outcome).lower()}"


def replace_folder(df: DataFrame, path: str, **options) -> int:
    """Writes a Parquet folder over one that may exist; returns the rows written.

    Spark's own overwrite deletes the old files first, even those that ``df`` reads.
    Here the rows are written beside them, and a failed write changes nothing.
    """
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        rows = write_folder(df, fresh, **options)
    except Exception:
        delete_folder(df.sparkSession, fresh)
        raise
    swap_in(df.sparkSession, fresh, path.rstrip("/"))
    return rows
