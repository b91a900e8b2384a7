"""Whole jobs: load, append, keyed write, copy, migrate, inventory."""

from lakehaul.plans.copies import (
    AppendedCopy,
    CopyResult,
    append_copy,
    copy_table,
    try_copy_table,
)
from lakehaul.plans.inventory import catalog_inventory
from lakehaul.plans.keyed import keyed_load
from lakehaul.plans.loading import (
    Loaded,
    create_append_read,
    create_insert_read,
    csv_to_parquet,
    csv_to_table,
)
from lakehaul.plans.migration import Migration, migrate_database, migrate_databases

__all__ = [
    "AppendedCopy",
    "CopyResult",
    "Loaded",
    "Migration",
    "append_copy",
    "catalog_inventory",
    "copy_table",
    "create_append_read",
    "create_insert_read",
    "csv_to_parquet",
    "csv_to_table",
    "keyed_load",
    "migrate_database",
    "migrate_databases",
    "try_copy_table",
]
