"""Every database and table of a catalog, with row counts."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from lakehaul.catalog import ListedTable, list_databases, list_tables
from lakehaul.errors import message_of
from lakehaul.names import TableRef
from lakehaul.operators.counts import TABLES_PER_JOB, try_count_tables
from lakehaul.sources.rows import report_rows
from lakehaul.threads import in_threads

log = logging.getLogger(__name__)

INVENTORY = StructType(
    [
        StructField("database", StringType()),
        StructField("table", StringType()),
        StructField("is_temporary", BooleanType()),
        StructField("row_count", LongType()),
        StructField("reason", StringType()),
    ]
)


def catalog_inventory(
    spark: SparkSession,
    catalog: str | None = None,
    tables_per_job: int = TABLES_PER_JOB,
    parallelism: int = 4,
) -> DataFrame:
    """One row per table; a null count means the table cannot be read, for ``reason``.

    Temporary views are listed with their flag and not counted, since they belong
    to no database.  A database without tables is one row with no table; if its tables
    cannot be listed, that row has a ``reason``.  ``parallelism`` listings or count jobs run at a time.
    """
    databases = list_databases(spark, catalog)
    entries = in_threads(
        spark, lambda database: _entries(spark, database, catalog), databases, parallelism
    )
    listed = [(database, entry) for database, of in zip(databases, entries) for entry in of]
    stored = [
        TableRef(database, entry.table, catalog)
        for database, entry in listed
        if isinstance(entry, ListedTable) and not entry.is_temporary
    ]
    counts = dict(zip(stored, try_count_tables(spark, stored, tables_per_job, parallelism)))
    rows = []
    for database, entry in listed:
        if entry is None or isinstance(entry, str):
            rows.append((database, None, None, None, entry))
        elif entry.is_temporary:
            rows.append((database, *entry, None, None))
        else:
            rows.append((database, *entry, *counts[TableRef(database, entry.table, catalog)]))
    return report_rows(spark, rows, INVENTORY)


def _entries(
    spark: SparkSession, database: str, catalog: str | None
) -> list[ListedTable] | list[str | None]:
    """Tables of a database; for none, why they cannot be listed, or ``None``."""
    try:
        return list_tables(spark, database, catalog) or [None]
    except Exception as error:
        log.warning("cannot list the tables of %s: %s", database, message_of(error))
        return [message_of(error)]
