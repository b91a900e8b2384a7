from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lakehaul.catalog import create_database
from lakehaul.names import TableRef
from lakehaul.plans.loading import Loaded
from lakehaul.sinks import keyed_replace, keyed_write
from lakehaul.sources import read_folder, read_table


def keyed_load(
    df: DataFrame,
    path: str | None,
    keys: Sequence[str],
    order_by: str,
    ties: Sequence[str] | None = None,
    register_as: TableRef | None = None,
) -> Loaded:
    """Latest row per key → folder, optionally named in a catalog → read back.

    Without a ``path`` the rows go to a version folder of the table ``register_as``, which is
    then pointed at it: nothing is renamed, readers never miss the table, and a failed load
    leaves it as it was.  With a ``path`` the folder is replaced by renames.
    """
    spark = df.sparkSession
    if register_as:
        create_database(spark, register_as.database, register_as.catalog)
    if path is None:
        if register_as is None:
            raise ValueError("a keyed load needs a path or a table")
        counts = keyed_replace(df, register_as, keys, order_by, ties)
        return Loaded(counts.target_count, read_table(spark, register_as))
    rows = keyed_write(df, path, keys, order_by, ties, register_as)
    return Loaded(rows, read_folder(spark, path, df.schema))
