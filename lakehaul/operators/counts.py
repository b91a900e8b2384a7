"""Row counts: as a query, riding on a write, and for many tables in one job."""

from __future__ import annotations

import logging
import threading
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakehaul.errors import message_of
from lakehaul.names import TableRef, table_name
from lakehaul.threads import in_threads

log = logging.getLogger(__name__)

# Tables counted by one Spark job; keeps the plan of a large catalog small.
TABLES_PER_JOB = 25
# Name of the count that rides on a write.
WRITTEN = "lakehaul_rows"


class Counted(NamedTuple):
    """Rows of a table, or why it could not be read."""

    rows: int | None
    reason: str | None = None


class CountMismatch(ValueError):
    """A copy holds another number of rows than its source."""

    def __init__(self, source: object, source_count: int, target: object, target_count: int):
        super().__init__(f"{source} has {source_count} rows, {target} has {target_count}")
        self.source_count = source_count
        self.target_count = target_count


def row_count(df: DataFrame) -> DataFrame:
    """One row, one column ``cnt``; no column of the source is read."""
    return df.agg(F.count(F.lit(1)).alias("cnt"))


def row_count_sql(spark: SparkSession, ref: TableRef) -> DataFrame:
    """The same as a SQL statement on a table."""
    return spark.sql(f"SELECT count(*) AS cnt FROM {table_name(spark, ref)}")


class CountLost(RuntimeError):
    """Rows were written, but their number did not reach the driver."""


class CountedWrite:
    """Counts rows while one action writes them, so that the source is read once.

        counted = CountedWrite(df)
        counted.rows.write.parquet(path)
        n = counted.count()

    ``extra`` are further aggregates of the same pass, by the names of their columns.  The
    values reach the driver as a listener event, and a very busy listener bus may drop events:
    then ``measured`` raises ``CountLost`` after ``patience`` seconds.  The source is never
    counted in its place, as by then it may hold other rows.
    """

    def __init__(self, df: DataFrame, patience: float = 60.0, extra: Sequence[Column] = ()):
        self._patience = patience
        self._observation = Observation()
        self.rows = df.observe(self._observation, F.count(F.lit(1)).alias(WRITTEN), *extra)

    def measured(self) -> dict:
        """All values of the pass."""
        seen: dict = {}
        waiter = threading.Thread(target=lambda: seen.update(self._observation.get), daemon=True)
        waiter.start()
        waiter.join(self._patience)
        if WRITTEN not in seen:
            raise CountLost("the rows were written, but their number did not reach the driver")
        return seen

    def count(self) -> int:
        return self.measured()[WRITTEN]


def count_tables(
    spark: SparkSession,
    refs: Sequence[TableRef],
    tables_per_job: int = TABLES_PER_JOB,
    parallelism: int = 4,
) -> list[int | None]:
    """Row counts of many tables, in order; ``None`` for one that cannot be read."""
    return [found.rows for found in try_count_tables(spark, refs, tables_per_job, parallelism)]


def try_count_tables(
    spark: SparkSession,
    refs: Sequence[TableRef],
    tables_per_job: int = TABLES_PER_JOB,
    parallelism: int = 4,
) -> list[Counted]:
    """The same, with the error of each table that cannot be read.

    Each job is a union of plain counts: a format that keeps counts in its
    metadata answers without a scan, and Parquet answers from file footers.  If a
    job fails, its tables are counted one by one to find the unreadable ones.
    """
    names = [table_name(spark, ref) for ref in refs]
    groups = [names[at : at + tables_per_job] for at in range(0, len(names), tables_per_job)]

    def count(group: Sequence[str]) -> list[Counted]:
        try:
            return [Counted(rows) for rows in _count_together(spark, group)]
        except Exception:
            return in_threads(spark, lambda name: _count_alone(spark, name), group, parallelism)

    return [count for counts in in_threads(spark, count, groups, parallelism) for count in counts]


def check_counts(spark: SparkSession, source: TableRef, target: TableRef) -> int:
    """The row count both tables share; raises ``CountMismatch`` if they differ."""
    names = [table_name(spark, ref) for ref in (source, target)]
    source_count, target_count = _count_together(spark, names)
    require_equal(source, source_count, target, target_count)
    return target_count


def require_equal(source: object, source_count: int, target: object, target_count: int) -> None:
    if source_count != target_count:
        raise CountMismatch(source, source_count, target, target_count)


def _count_together(spark: SparkSession, names: Sequence[str]) -> list[int]:
    union = " UNION ALL ".join(
        f"SELECT {at} AS slot, count(*) AS cnt FROM {name}" for at, name in enumerate(names)
    )
    by_slot = {row.slot: row.cnt for row in spark.sql(union).collect()}
    return [by_slot[at] for at in range(len(names))]


def _count_alone(spark: SparkSession, name: str) -> Counted:
    try:
        return Counted(_count_together(spark, [name])[0])
    except Exception as error:
        log.warning("cannot count %s", name, exc_info=error)
        return Counted(None, message_of(error))
