"""Databases, tables and views as catalog objects."""

from lakehaul.catalog.shapes import TableShape, described, partition_columns, table_shape
from lakehaul.catalog.statements import (
    ListedTable,
    create_database,
    describe_table,
    drop_database,
    drop_tables,
    list_databases,
    list_tables,
    register_view,
    set_current_database,
    set_table_properties,
    table_bytes,
    table_exists,
    table_properties,
)

__all__ = [
    "ListedTable",
    "TableShape",
    "create_database",
    "describe_table",
    "described",
    "drop_database",
    "drop_tables",
    "list_databases",
    "list_tables",
    "partition_columns",
    "register_view",
    "set_current_database",
    "set_table_properties",
    "table_bytes",
    "table_exists",
    "table_properties",
    "table_shape",
]
