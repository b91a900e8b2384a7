"""Writers: Parquet folders, tables, keyed tables."""

from lakehaul.sinks.files import (
    divided_folder,
    replace_folder,
    sized,
    write_divided,
    write_folder,
)
from lakehaul.sinks.keyed import keyed_replace, keyed_write
from lakehaul.sinks.tables import (
    CONTENT,
    COUNT,
    Written,
    append_table,
    clone_empty,
    create_table,
    insert_values,
    register_folder,
    replace_table,
    require_file_tables,
    require_reads,
)

__all__ = [
    "CONTENT",
    "COUNT",
    "Written",
    "append_table",
    "clone_empty",
    "create_table",
    "divided_folder",
    "insert_values",
    "keyed_replace",
    "keyed_write",
    "register_folder",
    "replace_folder",
    "replace_table",
    "require_file_tables",
    "require_reads",
    "sized",
    "write_divided",
    "write_folder",
]
