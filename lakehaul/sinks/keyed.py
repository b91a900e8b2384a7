"""Keyed tables: one row per record key, every write replaces the whole table.

The shuffle has the width the session gives it.  For very large inputs submit with
``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` at input bytes / 256 MiB:
adaptive execution merges what turns out small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lakehaul.names import TableRef
from lakehaul.operators.precombine import precombine, require_record_keys
from lakehaul.sinks.files import replace_folder
from lakehaul.sinks.tables import (
    Written,
    register_folder,
    replace_table,
    require_file_tables,
    require_reads,
)


def keyed_write(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    order_by: str,
    ties: Sequence[str] | None = None,
    register_as: TableRef | None = None,
) -> int:
    """Writes the latest row per key to a folder and returns the row count.

    Rows already in the folder are replaced, not merged.  The folder gets its name
    by a rename; where that copies the data, as on an object store, ``keyed_replace``
    is the cheaper one.
    """
    if register_as:
        require_file_tables(df.sparkSession, register_as)
        require_reads(df.sparkSession, register_as, path)
    latest = _latest(df, keys, order_by, ties)
    rows = replace_folder(latest, path)
    if register_as:
        spark, schema = df.sparkSession, latest.schema
        if not register_folder(spark, register_as, path, schema, renew=True):
            raise ValueError(f"{register_as} exists and reads another folder than {path}")
    return rows


def keyed_replace(
    df: DataFrame,
    target: TableRef,
    keys: Sequence[str],
    order_by: str,
    ties: Sequence[str] | None = None,
    provider: str | None = None,
) -> Written:
    """The same into a catalog table; only the table's location changes."""
    latest = _latest(df, keys, order_by, ties)
    return replace_table(latest, target, provider)


def _latest(
    df: DataFrame, keys: Sequence[str], order_by: str, ties: Sequence[str] | None
) -> DataFrame:
    return precombine(require_record_keys(df, keys), keys, order_by, ties)
