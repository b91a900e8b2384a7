"""Readers: CSV folders, Parquet folders, literal rows, tables and views."""

from lakehaul.sources.files import read_csv, read_csv_marked, read_folder
from lakehaul.sources.rows import literal_rows
from lakehaul.sources.tables import read_sql, read_table, read_view

__all__ = ["literal_rows", "read_csv", "read_csv_marked", "read_folder", "read_sql", "read_table", "read_view"]
