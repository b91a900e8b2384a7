from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from lakehaul.names import (
    PREFIX_END,
    TableRef,
    catalog_name,
    database_name,
    database_prefix,
    is_plugin,
    prefixes_allowed,
    table_name,
    text,
)
from lakehaul.storage import delete_folder, folder_bytes, plan_bytes, same_folder


# Table property: the folder a table pointed to before its present one.
PREVIOUS = "lakehaul.previous"


class ListedTable(NamedTuple):
    table: str
    is_temporary: bool


def create_database(
    spark: SparkSession, database: str, catalog: str | None = None, location: str | None = None
) -> None:
    """Creates the database if it is missing."""
    where = f" LOCATION {text(location)}" if location else ""
    name = database_name(spark, database, catalog)
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}{where}")


def drop_database(
    spark: SparkSession, database: str, catalog: str | None = None, cascade: bool = False
) -> None:
    """Drops the database if it exists; with ``cascade`` its tables go too."""
    name = database_name(spark, database, catalog)
    spark.sql(f"DROP NAMESPACE IF EXISTS {name}{' CASCADE' if cascade else ''}")


def set_current_database(spark: SparkSession, database: str, catalog: str | None = None) -> None:
    """Makes unqualified table names in the user's own SQL refer to this database."""
    spark.sql(f"USE {database_name(spark, database, catalog)}")


def list_databases(spark: SparkSession, catalog: str | None = None) -> list[str]:
    """Database names of one catalog.

    Where catalog names may be prefixes, a catalog's databases carry no further one,
    so none is listed under two catalogs.
    """
    prefix = database_prefix(spark, catalog)
    rows = spark.sql(f"SHOW NAMESPACES IN {catalog_name(spark, catalog)}").collect()
    names = [row.namespace[len(prefix) :] for row in rows if row.namespace.startswith(prefix)]
    if is_plugin(spark, catalog) or not prefixes_allowed(spark):
        return names
    return [name for name in names if PREFIX_END not in name]


def list_tables(
    spark: SparkSession, database: str, catalog: str | None = None
) -> list[ListedTable]:
    """Tables of one database.

    The session catalog adds the session's temporary views to every listing, so
    each entry says whether it is one.
    """
    rows = spark.sql(f"SHOW TABLES IN {database_name(spark, database, catalog)}").collect()
    return [ListedTable(row.tableName, row.isTemporary) for row in rows]


def table_exists(spark: SparkSession, ref: TableRef) -> bool:
    return spark.catalog.tableExists(table_name(spark, ref))


def register_view(df: DataFrame, view: str) -> None:
    """A temporary view of this session."""
    df.createOrReplaceTempView(view)


def describe_table(spark: SparkSession, ref: TableRef) -> DataFrame:
    """Columns and details of a table."""
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table_name(spark, ref)}")


def set_table_properties(
    spark: SparkSession, ref: TableRef, properties: Mapping[str, str]
) -> None:
    pairs = ", ".join(f"{text(key)} = {text(value)}" for key, value in properties.items())
    spark.sql(f"ALTER TABLE {table_name(spark, ref)} SET TBLPROPERTIES ({pairs})")


def table_properties(spark: SparkSession, ref: TableRef) -> DataFrame:
    """Columns ``key`` and ``value``."""
    return spark.sql(f"SHOW TBLPROPERTIES {table_name(spark, ref)}")


def drop_tables(spark: SparkSession, refs: Iterable[TableRef]) -> None:
    """Drops each table if it exists, with the folders of versions published for it.

    A folder that a user registered is never deleted.
    """
    for ref in refs:
        name = table_name(spark, ref)
        if is_plugin(spark, ref.catalog):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif table_exists(spark, ref):
            old = details(spark, ref)
            spark.sql(f"DROP TABLE {name}")
            delete_previous(spark, ref, old)
            if is_version(spark, ref, old["location"]):
                delete_folder(spark, old["location"])


def details(spark: SparkSession, ref: TableRef) -> dict:
    """Session catalog only: location, type, provider, columns and properties."""
    [row] = spark.sql(f"DESCRIBE TABLE EXTENDED {table_name(spark, ref)} AS JSON").collect()
    return json.loads(row[0])


def table_bytes(spark: SparkSession, ref: TableRef) -> int | None:
    """Size of a table's files, without reading one; ``None`` where it is not known."""
    if is_plugin(spark, ref.catalog):
        return plan_bytes(spark.table(table_name(spark, ref)))
    location = details(spark, ref).get("location")
    return folder_bytes(spark, location) if location else None


def delete_previous(spark: SparkSession, ref: TableRef, details: dict) -> None:
    """Deletes the version that the described table pointed to before its present one.

    Its folder is taken from a table property, so it must lie where this table's own
    folders lie and not be in use.
    """
    previous = details.get("table_properties", {}).get(PREVIOUS)
    if not previous or same_folder(spark, previous, details["location"]):
        return
    if is_version(spark, ref, previous) or is_default_folder(spark, ref, previous):
        delete_folder(spark, previous)


def versions_folder(spark: SparkSession, ref: TableRef) -> str:
    """Session catalog only: parent of the folders that a replaced table points to."""
    return f"{database_folder(spark, ref)}/{ref.table}.versions"


def is_version(spark: SparkSession, ref: TableRef, folder: str) -> bool:
    return folder.startswith(versions_folder(spark, ref) + "/")


def is_default_folder(spark: SparkSession, ref: TableRef, folder: str) -> bool:
    """True for the folder Spark gives a managed table of this name."""
    return same_folder(spark, folder, default_folder(spark, ref))


def default_folder(spark: SparkSession, ref: TableRef) -> str:
    return f"{database_folder(spark, ref)}/{ref.table}"


def database_folder(spark: SparkSession, ref: TableRef) -> str:
    database = spark.catalog.getDatabase(database_name(spark, ref.database, ref.catalog))
    return unquote(database.locationUri).rstrip("/")
