"""All tables of one or many databases copied to another catalog, with a report."""

from __future__ import annotations

import logging
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from lakehaul.catalog import create_database, list_databases, list_tables, table_bytes
from lakehaul.errors import message_of
from lakehaul.names import TableRef, catalog_name
from lakehaul.plans.copies import try_copy_table
from lakehaul.plans.ledger import Ledger
from lakehaul.sinks import COUNT
from lakehaul.sources.rows import report_rows
from lakehaul.threads import largest_first

log = logging.getLogger(__name__)

COMPLETED, FAILED, SKIPPED = "completed", "failed", "skipped"

REPORT = StructType(
    [
        StructField("database", StringType()),
        StructField("status", StringType()),
        StructField("reason", StringType()),
        StructField("table", StringType()),
        StructField("source_count", LongType()),
        StructField("dest_count", LongType()),
        StructField("succeeded", BooleanType()),
    ]
)
DURATIONS = StructType(
    [
        StructField("database", StringType()),
        StructField("status", StringType()),
        StructField("total_tables", LongType()),
        StructField("successful", LongType()),
        StructField("failed", LongType()),
        StructField("seconds", DoubleType()),
    ]
)


class Migration(NamedTuple):
    """``report`` has a row per table, ``durations`` a row per database.

    A database without tables, or one that was skipped or failed, is one report
    row with no table.
    """

    report: DataFrame
    durations: DataFrame


def migrate_database(
    spark: SparkSession,
    database: str,
    source_catalog: str | None,
    target_catalog: str | None,
    provider: str | None = None,
    parallelism: int = 4,
    ledger: str | None = None,
    check: str = COUNT,
) -> DataFrame:
    """Copies every table of one database; the report as a frame.

    A table that fails does not stop the others.  Raises only if the target
    database cannot be created or the tables cannot be listed.  ``ledger`` and ``check``
    as in ``migrate_databases``.
    """
    run = _Run(spark, source_catalog, target_catalog, provider, ledger, check)
    listed = run.prepare(database)
    largest_first(spark, [listed], lambda tables: tables, run.copy, parallelism)
    rows = run.report(database) or [_no_table(database, COMPLETED, None)]
    return report_rows(spark, rows, REPORT)


def migrate_databases(
    spark: SparkSession,
    selector: str,
    source_catalog: str | None,
    target_catalog: str | None,
    provider: str | None = None,
    parallelism: int = 4,
    ledger: str | None = None,
    check: str = COUNT,
) -> Migration:
    """Copies the databases named in ``selector``: ``"*"``, or a list like ``"a, b"``.

    Databases and tables keep their names.  ``parallelism`` tables are copied at a
    time, whatever database they are in, the largest of those listed so far first; copies begin
    as soon as there is no more database to list for a thread.  The report keeps the order of
    the listing.  A catalog the session does not know is an error before anything is written.

    ``ledger`` is a folder in which every finished table leaves an entry.  The same call
    again, after a stop or a failure, copies only what did not succeed before or is no more in
    the target, and reports all tables as if it had run through; ``seconds`` are those of the
    last run.  A source that changed since its copy is not copied again: take a new ledger
    for that.  ``check="content"`` compares the rows of every copy, not only their number.
    """
    catalog_name(spark, target_catalog)
    available = list_databases(spark, source_catalog)
    selected = available if selector == "*" else _names(selector)
    ended = {name: _no_table(name, SKIPPED, "database not found") for name in selected}
    preparing = dict.fromkeys(selected, 0.0)
    run = _Run(spark, source_catalog, target_catalog, provider, ledger, check)

    def prepare(database: str) -> list[tuple[int, tuple[str, str]]]:
        started = time.monotonic()
        try:
            tables = run.prepare(database)
            ended[database] = _no_table(database, COMPLETED, None)
            return tables
        except Exception as error:
            log.warning("cannot migrate %s", database, exc_info=error)
            ended[database] = _no_table(database, FAILED, message_of(error))
            return []
        finally:
            preparing[database] = time.monotonic() - started

    found = [name for name in ended if name in set(available)]
    largest_first(spark, found, prepare, run.copy, parallelism)
    report = [row for name in ended for row in (run.report(name) or [ended[name]])]
    durations = [_summary(ended[name], run.report(name), run.seconds(name), preparing[name]) for name in ended]
    return Migration(
        report_rows(spark, report, REPORT), report_rows(spark, durations, DURATIONS)
    )


class _Run:
    """The tables of one migration: which are listed, which are done, and how they ended."""

    def __init__(
        self,
        spark: SparkSession,
        source_catalog: str | None,
        target_catalog: str | None,
        provider: str | None,
        ledger: str | None,
        check: str,
    ):
        self.spark, self.source, self.target = spark, source_catalog, target_catalog
        self.provider, self.check = provider, check
        self.ledger = Ledger(spark, ledger, source_catalog, target_catalog) if ledger else None
        self.before = self.ledger.finished() if self.ledger else {}
        self.listed: dict[str, list[str]] = {}
        self.ended: dict[tuple[str, str], tuple] = {}
        self.times: dict[tuple[str, str], tuple[float, float]] = {}

    def prepare(self, database: str) -> list[tuple[int, tuple[str, str]]]:
        """Creates the target database; the tables to copy into it, with their sizes."""
        create_database(self.spark, database, self.target)
        tables = [t.table for t in list_tables(self.spark, database, self.source) if not t.is_temporary]
        self.listed[database] = tables
        known = {table for of, table in self.before if of == database}
        if known:
            known &= {t.table for t in list_tables(self.spark, database, self.target)}
        for table in known.intersection(tables):
            entry = self.before[database, table]
            self.ended[database, table] = self._row(
                database, table, (entry["source_count"], entry["dest_count"]), None
            )
        return [(self._size(database, table), (database, table)) for table in tables if table not in known]

    def copy(self, names: tuple[str, str]) -> None:
        started, clock = time.time(), time.monotonic()
        source, target = TableRef(*names, self.source), TableRef(*names, self.target)
        result = try_copy_table(self.spark, source, target, self.provider, self.check)
        counts = (result.source_count, result.target_count)
        if self.ledger:
            self.ledger.append(*names, counts, result.error, started, time.time())
        self.ended[names] = self._row(*names, counts, result.error)
        self.times[names] = (clock, time.monotonic())
        done, known = len(self.ended), sum(map(len, self.listed.values()))
        log.info("%s: %s (%d of %d tables listed so far)", source, result.error or "copied", done, known)

    def report(self, database: str) -> list[tuple]:
        """A row per table, in the order of the listing."""
        return [self.ended[database, table] for table in self.listed.get(database, [])]

    def seconds(self, database: str) -> float:
        """From the first copy of this run to the end of its last."""
        times = [both for (of, _), both in self.times.items() if of == database]
        return max(end for _, end in times) - min(start for start, _ in times) if times else 0.0

    def _size(self, database: str, table: str) -> int:
        try:
            return table_bytes(self.spark, TableRef(database, table, self.source)) or 0
        except Exception as error:
            # The copy will say what is wrong with the table.
            log.warning("no size of %s.%s: %s", database, table, message_of(error))
            return 0

    @staticmethod
    def _row(database: str, table: str, counts: tuple, error: str | None) -> tuple:
        return (database, COMPLETED, error, table, *counts, error is None)


def _names(selector: str) -> list[str]:
    return list(dict.fromkeys(name.strip() for name in selector.split(",")))


def _no_table(database: str, status: str, reason: str | None) -> tuple:
    return (database, status, reason, None, None, None, None)


def _summary(ended: tuple, rows: list[tuple], copying: float, preparing: float) -> tuple:
    """Tables of one database, and the seconds of listing and copying them."""
    successful = sum(row[-1] for row in rows)
    return (*ended[:2], len(rows), successful, len(rows) - successful, preparing + copying)
