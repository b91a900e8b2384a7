"""One table copied to another name or catalog."""

from __future__ import annotations

import logging
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from lakehaul.catalog import create_database, table_bytes, table_shape
from lakehaul.errors import message_of
from lakehaul.names import TableRef
from lakehaul.operators import CountMismatch, first_rows
from lakehaul.sinks import COUNT, Written, append_table, clone_empty, replace_table
from lakehaul.sources import read_table

log = logging.getLogger(__name__)


class CopyResult(NamedTuple):
    source_count: int | None
    target_count: int | None
    error: str | None = None

    @property
    def succeeded(self) -> bool:
        return self.error is None


class AppendedCopy(NamedTuple):
    """Rows appended, rows the target then holds, and a few rows of either side."""

    source_count: int
    target_count: int
    source_sample: DataFrame
    target_sample: DataFrame


def copy_table(
    spark: SparkSession,
    source: TableRef,
    target: TableRef,
    provider: str | None = None,
    check: str = COUNT,
    file_bytes: int | None = None,
) -> CopyResult:
    """Replaces the target by the source's rows and declaration and checks the count.

    Partitions, comments, defaults, text lengths and properties are declared as the source
    does.  ``check="content"`` compares fingerprints of the rows too, ``file_bytes`` makes
    files of about that size; see ``replace_table``.  Running it again gives the same table.
    Raises if the copy fails.
    """
    create_database(spark, target.database, target.catalog)
    counts = _replace(spark, source, target, provider, check, file_bytes)
    return CopyResult(counts.source_count, counts.target_count)


def try_copy_table(
    spark: SparkSession,
    source: TableRef,
    target: TableRef,
    provider: str | None = None,
    check: str = COUNT,
    file_bytes: int | None = None,
) -> CopyResult:
    """``copy_table`` whose failure is a result, so that a list of copies goes on.

    The target database must exist.
    """
    try:
        counts = _replace(spark, source, target, provider, check, file_bytes)
        return CopyResult(counts.source_count, counts.target_count)
    except CountMismatch as error:
        return CopyResult(error.source_count, error.target_count, str(error))
    except Exception as error:
        log.warning("copy of %s failed", source, exc_info=error)
        return CopyResult(None, None, message_of(error))


def _replace(
    spark: SparkSession,
    source: TableRef,
    target: TableRef,
    provider: str | None,
    check: str,
    file_bytes: int | None,
) -> Written:
    return replace_table(
        read_table(spark, source),
        target,
        provider,
        shape=table_shape(spark, source),
        check=check,
        file_bytes=file_bytes,
        input_bytes=table_bytes(spark, source) if file_bytes else None,
    )


def append_copy(
    spark: SparkSession,
    source: TableRef,
    target: TableRef,
    provider: str | None = None,
    location: str | None = None,
    sample: int = 5,
) -> AppendedCopy:
    """Appends the source's rows to the target, first created empty if missing.

    Running it again doubles the rows; ``copy_table`` does not.
    """
    create_database(spark, target.database, target.catalog)
    clone_empty(spark, source, target, provider, location)
    appended = append_table(read_table(spark, source), target)
    copied = read_table(spark, target)
    return AppendedCopy(
        appended,
        copied.count(),
        first_rows(read_table(spark, source), sample),
        first_rows(copied, sample),
    )
