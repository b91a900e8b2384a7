"""Command line of the jobs, for ``spark-submit submit.py <job> ...``.

The session takes its catalogs, executors and memory from the submit settings.
Tables are named ``catalog.database.table`` or ``database.table``.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lakehaul.catalog import create_database, drop_database, drop_tables
from lakehaul.names import TableRef
from lakehaul.plans import (
    append_copy,
    catalog_inventory,
    copy_table,
    create_append_read,
    csv_to_parquet,
    csv_to_table,
    keyed_load,
    migrate_databases,
)
from lakehaul.sinks import CONTENT, COUNT
from lakehaul.sources import read_table


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="lakehaul", description=__doc__)
    jobs = root.add_subparsers(dest="job", required=True)

    def job(name: str, run, *positional: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=run.__doc__)
        for argument in positional:
            sub.add_argument(argument)
        sub.set_defaults(run=run)
        return sub

    load = job("load", _load, "input_folder", "output_folder")
    load.add_argument("--table", help="also register the output under this name")
    load.add_argument("--schema", help="column list; without it types are inferred")
    load.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="of the CSV reader")
    load.add_argument("--quarantine", action="store_true", help="set rows aside that do not fit")
    append = job("append", _append, "source_table", "target_table")
    append.add_argument("--provider")
    append.add_argument("--location")
    keyed = job("keyed", _keyed, "source_table")
    keyed.add_argument("output_folder", nargs="?", help="without it --table gets a version of its own")
    keyed.add_argument("--keys", required=True, help="comma-separated record key")
    keyed.add_argument("--order-by", required=True)
    keyed.add_argument("--ties", help="comma-separated columns that settle equal --order-by values")
    keyed.add_argument("--table", help="also register the output under this name")
    copy = job("copy", _copy, "source_table", "target_table")
    copy.add_argument("--append", action="store_true", help="append instead of replace")
    copy.add_argument("--location", help="folder of the appended copy")
    copy.add_argument("--provider")
    copy.add_argument("--check", choices=[COUNT, CONTENT], default=COUNT, help="of a replaced copy")
    copy.add_argument("--file-bytes", type=int, help="size of a replaced copy's files")
    migrate = job("migrate", _migrate, "databases", "source_catalog", "target_catalog")
    migrate.add_argument("--provider")
    migrate.add_argument("--parallelism", type=int, default=4)
    migrate.add_argument("--ledger", help="folder of finished tables, to go on after a stop")
    migrate.add_argument("--check", choices=[COUNT, CONTENT], default=COUNT)
    inventory = job("inventory", _inventory)
    inventory.add_argument("--catalog")
    inventory.add_argument("--parallelism", type=int, default=4)
    clean = job("clean", _clean)
    clean.add_argument("--tables", default="", help="comma-separated tables to drop")
    clean.add_argument("--database", help="database to drop, as catalog.database or database")
    return root


def main(arguments: Sequence[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO)
    given = parser().parse_args(arguments)
    failed = given.run(SparkSession.builder.appName(f"lakehaul-{given.job}").getOrCreate(), given)
    return 1 if failed else 0


def _load(spark: SparkSession, given: argparse.Namespace) -> None:
    """CSV folder to Parquet folder, with the load time"""
    folders = (given.input_folder, given.output_folder)
    options = dict(option.split("=", 1) for option in given.option)
    options |= {"schema": given.schema, "quarantine": given.quarantine}
    if given.table:
        loaded = csv_to_table(spark, *folders, TableRef.of(given.table), **options)
    else:
        loaded = csv_to_parquet(spark, *folders, **options)
    loaded.data.printSchema()
    loaded.data.show()
    print(f"rows: {loaded.rows}")
    if loaded.quarantined is not None:
        loaded.quarantined.show(truncate=False)
        print(f"rows set aside: {loaded.bad_rows}")


def _append(spark: SparkSession, given: argparse.Namespace) -> None:
    """rows of one table appended to another, created if missing"""
    target = TableRef.of(given.target_table)
    create_database(spark, target.database, target.catalog)
    rows = read_table(spark, TableRef.of(given.source_table))
    create_append_read(
        rows, target, provider=given.provider, location=given.location
    ).data.show()


def _keyed(spark: SparkSession, given: argparse.Namespace) -> None:
    """latest row per record key to a Parquet folder"""
    keyed_load(
        read_table(spark, TableRef.of(given.source_table)),
        given.output_folder,
        [key.strip() for key in given.keys.split(",")],
        given.order_by,
        ties=[tie.strip() for tie in given.ties.split(",")] if given.ties else None,
        register_as=TableRef.of(given.table) if given.table else None,
    ).data.show()


def _copy(spark: SparkSession, given: argparse.Namespace) -> None:
    """one table copied and counted"""
    tables = (TableRef.of(given.source_table), TableRef.of(given.target_table))
    if not given.append:
        print(copy_table(spark, *tables, given.provider, given.check, given.file_bytes))
        return
    copied = append_copy(spark, *tables, given.provider, given.location)
    print(f"rows appended: {copied.source_count}, rows in the copy: {copied.target_count}")
    copied.source_sample.show()
    copied.target_sample.show()


def _migrate(spark: SparkSession, given: argparse.Namespace) -> bool:
    """databases ("*" or a comma-separated list) copied; fails if any table or database did"""
    done = migrate_databases(
        spark,
        given.databases,
        given.source_catalog,
        given.target_catalog,
        given.provider,
        given.parallelism,
        given.ledger,
        given.check,
    )
    _show_all(done.report)
    _show_all(done.durations)
    return not done.report.where("status <> 'completed' OR NOT succeeded").isEmpty()


def _inventory(spark: SparkSession, given: argparse.Namespace) -> None:
    """all tables of a catalog with their row counts"""
    _show_all(catalog_inventory(spark, given.catalog, parallelism=given.parallelism))


def _show_all(report: DataFrame) -> None:
    """Reports have a row per table or database and are local already."""
    report.show(report.count(), truncate=False)


def _clean(spark: SparkSession, given: argparse.Namespace) -> None:
    """tables and a database dropped"""
    drop_tables(spark, [TableRef.of(name.strip()) for name in given.tables.split(",") if name])
    if given.database:
        catalog, _, database = given.database.rpartition(".")
        drop_database(spark, database, catalog or None, cascade=True)
