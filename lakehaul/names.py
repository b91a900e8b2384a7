"""Catalog, database and table names as SQL text.

A catalog that the session configures (``spark.sql.catalog.<name>``) is used as
it is.  Any other catalog name is an error, unless the session sets
``spark.lakehaul.catalogPrefixes`` to ``true``: then it is a prefix, and database
``db`` of catalog ``src`` is the session database ``src__db``.  That way a copy from
one catalog to another can be run where the session catalog is the only one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

SESSION_CATALOG = "spark_catalog"
PREFIX_END = "__"
PREFIXES = "spark.lakehaul.catalogPrefixes"


@dataclass(frozen=True)
class TableRef:
    """One table: ``TableRef("sales", "orders", "src")`` is ``src.sales.orders``."""

    database: str
    table: str
    catalog: str | None = None

    @classmethod
    def of(cls, name: str) -> TableRef:
        """Reads ``db.table`` or ``catalog.db.table``; no part may hold a dot."""
        parts = name.split(".")
        if len(parts) not in (2, 3) or not all(parts):
            raise ValueError(f"expected db.table or catalog.db.table, got {name!r}")
        return cls(parts[-2], parts[-1], parts[0] if len(parts) == 3 else None)

    def __str__(self) -> str:
        return ".".join(part for part in (self.catalog, self.database, self.table) if part)


def quote(*parts: str) -> str:
    """Back-quotes each part and joins them with dots."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_plugin(spark: SparkSession, catalog: str | None) -> bool:
    """True if the session configures this catalog (default: the current one)."""
    catalog = catalog or spark.catalog.currentCatalog()
    return spark.conf.get(f"spark.sql.catalog.{catalog}", None) not in (None, "builtin")


def prefixes_allowed(spark: SparkSession) -> bool:
    return spark.conf.get(PREFIXES, "false").lower() == "true"


def database_prefix(spark: SparkSession, catalog: str | None) -> str:
    """What stands before a database name in the session catalog."""
    if catalog in (None, SESSION_CATALOG) or is_plugin(spark, catalog):
        return ""
    if not prefixes_allowed(spark):
        raise ValueError(f"the session configures no catalog {catalog}")
    if PREFIX_END in catalog:
        raise ValueError(f"a catalog name that is a prefix cannot hold {PREFIX_END}: {catalog}")
    return catalog + PREFIX_END


def catalog_name(spark: SparkSession, catalog: str | None) -> str:
    """Quoted name of the catalog that holds the databases; an unknown one is an error."""
    if is_plugin(spark, catalog):
        return quote(catalog or spark.catalog.currentCatalog())
    database_prefix(spark, catalog)
    return quote(SESSION_CATALOG)


def database_name(spark: SparkSession, database: str, catalog: str | None = None) -> str:
    """Quoted, qualified database name."""
    prefix = database_prefix(spark, catalog)
    if prefix and PREFIX_END in database:
        raise ValueError(f"a database of {catalog} cannot hold {PREFIX_END}: {database}")
    return f"{catalog_name(spark, catalog)}.{quote(prefix + database)}"


def table_name(spark: SparkSession, ref: TableRef) -> str:
    """Quoted, qualified table name."""
    return f"{database_name(spark, ref.database, ref.catalog)}.{quote(ref.table)}"
