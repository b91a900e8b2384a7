"""CSV to Parquet with a load time, and tables filled by append or insert."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakehaul.catalog import create_database, register_view
from lakehaul.names import TableRef
from lakehaul.operators import optional, with_load_time
from lakehaul.sinks import (
    append_table,
    create_table,
    divided_folder,
    insert_values,
    register_folder,
    require_file_tables,
    require_reads,
    write_divided,
    write_folder,
)
from lakehaul.sources import read_csv, read_csv_marked, read_folder, read_sql, read_table
from lakehaul.sources.files import BAD_FILE, BAD_REASON, BAD_RECORD
from lakehaul.storage import folder_exists

# Partition column of an output with a quarantine.
QUARANTINED = "quarantined"


class Loaded(NamedTuple):
    """Row count, and the output as a frame: its schema, a sample, further work.

    A load with quarantine also tells how many rows it set aside, and which.
    """

    rows: int
    data: DataFrame
    bad_rows: int = 0
    quarantined: DataFrame | None = None


def csv_to_parquet(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    load_time: datetime | None = None,
    column: str = "current_date",
    schema: StructType | str | None = None,
    quarantine: bool = False,
    **csv_options,
) -> Loaded:
    """CSV folder → load time column → new Parquet folder.

    One pass over the input, which also counts it; one more before that if the
    types are to be inferred.  An output that exists is refused before either.

    With ``quarantine``, which needs a ``schema``, rows that do not fit it do not fail the job.
    The same pass writes the others to ``quarantined=false`` in the output folder and
    these to ``quarantined=true``, with the record, its file and the reason; both are counted,
    and together they are all rows of the input.
    """
    if folder_exists(spark, output_path):
        raise FileExistsError(f"output folder exists: {output_path}")
    if quarantine:
        if schema is None:
            raise ValueError("a quarantine needs a schema")
        marked = read_csv_marked(spark, input_path, schema, **csv_options)
        stamped = with_load_time(marked, load_time, column)
        told = [BAD_RECORD, BAD_FILE, BAD_REASON]
        rows, bad_rows = write_divided(stamped, output_path, F.col(BAD_RECORD).isNotNull(), QUARANTINED)
        good, bad = (divided_folder(output_path, QUARANTINED, flag) for flag in (False, True))
        kept = StructType([field for field in stamped.schema if field.name not in told])
        aside = StructType([stamped.schema[name] for name in (*told, column)])
        return Loaded(rows, read_folder(spark, good, kept), bad_rows, read_folder(spark, bad, aside))
    stamped = with_load_time(read_csv(spark, input_path, schema, **csv_options), load_time, column)
    rows = write_folder(stamped, output_path)
    return Loaded(rows, read_folder(spark, output_path, stamped.schema))


def csv_to_table(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    target: TableRef,
    view: str | None = None,
    **options,
) -> Loaded:
    """``csv_to_parquet``, then the output folder as an external table.

    With ``quarantine`` the table holds the rows that fit.  The database is created if missing.  A table that exists stays as it is; if it
    reads another folder the load is refused before any pass.
    ``view`` also names a temporary view of the output.
    """
    require_file_tables(spark, target)
    create_database(spark, target.database, target.catalog)
    folder = output_path
    if options.get("quarantine"):
        folder = divided_folder(output_path, QUARANTINED, False)
    require_reads(spark, target, folder)
    loaded = csv_to_parquet(spark, input_path, output_path, **options)
    if view:
        register_view(loaded.data, view)
    register_folder(spark, target, folder, loaded.data.schema)
    return loaded


def create_append_read(
    df: DataFrame,
    target: TableRef,
    columns: StructType | str | None = None,
    provider: str | None = None,
    location: str | None = None,
) -> Loaded:
    """Declares the table if missing, appends the rows, reads the table back."""
    spark = df.sparkSession
    create_table(spark, target, columns or optional(df.schema), provider, location)
    return Loaded(append_table(df, target), read_table(spark, target))


def create_insert_read(
    spark: SparkSession,
    target: TableRef,
    columns: StructType | str,
    values: str,
    args: Mapping[str, object] | None = None,
    provider: str | None = None,
) -> DataFrame:
    """Declares a new table, inserts literal rows, reads the table back."""
    create_table(spark, target, columns, provider, if_not_exists=False)
    insert_values(spark, target, values, args)
    return read_sql(spark, target)
