"""Table writers for catalogs with their own table format and for the session catalog.

A catalog plug-in gets Spark's table writer, whose replace is the catalog's own
transaction.  Parquet tables of the session catalog know no replace, so there a
new version is written to a folder of its own, checked, and then the table is
pointed at that folder.  Only metadata changes at that moment: no file is moved,
readers that already planned keep the old files, and a failed write leaves the
old table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakehaul.catalog.shapes import TableShape, table_shape, type_text
from lakehaul.catalog.statements import (
    PREVIOUS,
    default_folder,
    delete_previous,
    details,
    is_default_folder,
    is_version,
    set_table_properties,
    table_exists,
    versions_folder,
)
from lakehaul.names import (
    SESSION_CATALOG,
    TableRef,
    catalog_name,
    is_plugin,
    quote,
    table_name,
    text,
)
from lakehaul.operators.columns import optional
from lakehaul.operators.counts import CountedWrite, require_equal
from lakehaul.operators.fingerprint import (
    fingerprint,
    fingerprint_columns,
    fingerprint_of,
    require_same_content,
)
from lakehaul.sinks.files import sized
from lakehaul.sources.files import read_folder
from lakehaul.sources.tables import read_table
from lakehaul.storage import delete_folder, is_empty, same_folder

DEFAULT_PROVIDER = "parquet"
# Folder name of the partition of null.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# How a copy is compared with its source.
COUNT, CONTENT = "count", "content"


class Written(NamedTuple):
    """Rows that came from the source, and rows then found in the target."""

    source_count: int
    target_count: int


def create_table(
    spark: SparkSession,
    ref: TableRef,
    columns: StructType | str,
    provider: str | None = None,
    location: str | None = None,
    if_not_exists: bool = True,
    partition_by: Sequence[str] = (),
) -> None:
    """An empty table with declared columns (a schema, or the text of the column list)."""
    columns = columns if isinstance(columns, str) else columns.toDDL()
    parts = f" PARTITIONED BY ({', '.join(map(quote, partition_by))})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{table_name(spark, ref)}"
        f" ({columns}){_using(spark, ref, provider)}{parts}{_at(location)}"
    )


def clone_empty(
    spark: SparkSession,
    source: TableRef,
    target: TableRef,
    provider: str | None = None,
    location: str | None = None,
) -> None:
    """A table declared as ``source`` is, without rows; no-op if it exists.

    Partitions, comments, defaults, text lengths and properties are declared too.
    ``location`` must not hold files: on the session catalog they would be deleted.
    """
    if table_exists(spark, target):
        return
    plugin = is_plugin(spark, target.catalog)
    if location and not plugin and not is_empty(spark, location):
        raise ValueError(f"location of an empty clone holds files: {location}")
    name, using = table_name(spark, target), _using(spark, target, provider)
    shape = table_shape(spark, source)
    if plugin:
        # The catalog takes the columns, comments included, from the query.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name}{using}{_at(location)}{shape.clauses()}"
            f" AS SELECT * FROM {table_name(spark, source)} WHERE 1 = 0"
        )
    else:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({shape.column_list()}){using}{_at(location)}"
            f"{shape.clauses()}"
        )


def append_table(df: DataFrame, target: TableRef) -> int:
    """Adds rows to an existing table, columns matched by name; returns how many.

    Appending the same rows again doubles them.
    """
    spark = df.sparkSession
    counted = CountedWrite(df)
    if is_plugin(spark, target.catalog):
        counted.rows.writeTo(table_name(spark, target)).append()
    else:
        columns = read_table(spark, target).columns
        if len(columns) != len(df.columns):
            raise ValueError(f"{target} has columns {columns}, the rows have {df.columns}")
        in_order = [counted.rows[quote(column)] for column in columns]
        counted.rows.select(*in_order).write.insertInto(table_name(spark, target))
    return counted.count()


def insert_values(
    spark: SparkSession, target: TableRef, values: str, args: Mapping[str, object] | None = None
) -> None:
    """Inserts rows given as SQL: ``"(:id, 'a', current_timestamp()), (2, 'b', NULL)"``.

    Values that come from outside belong in ``args``, not in the text.
    """
    spark.sql(f"INSERT INTO {table_name(spark, target)} VALUES {values}", args=args)


def replace_table(
    df: DataFrame,
    target: TableRef,
    provider: str | None = None,
    partition_by: Sequence[str] = (),
    shape: TableShape | None = None,
    check: str = COUNT,
    file_bytes: int | None = None,
    input_bytes: int | None = None,
) -> Written:
    """Creates the table from these rows, or replaces its rows and columns.

    The source is read once, by the write; the new table is counted afterwards and
    ``CountMismatch`` raised if it differs.  With ``check="content"`` the write also takes a
    fingerprint of its rows, which one scan of the new table has to give again, or else
    ``ContentMismatch`` is raised.  ``df`` may read the target itself.

    ``partition_by`` names partition columns, ``shape`` all that the table declares, partitions
    included.  ``file_bytes`` deals the rows to files of about that size, with one shuffle;
    ``input_bytes`` says how large the rows are where Spark cannot tell.  Without it no row is
    shuffled, and files are as many as the source's tasks.
    """
    spark = df.sparkSession
    shape = shape or TableShape(optional(df.schema), tuple(partition_by))
    rows = sized(df, file_bytes, shape.partition_by, input_bytes) if file_bytes else df
    if is_plugin(spark, target.catalog):
        return _replace_in_plugin(df, rows, target, provider, shape, check)
    provider = provider or DEFAULT_PROVIDER
    location = f"{versions_folder(spark, target)}/{uuid.uuid4().hex}"
    extra = fingerprint_columns(df.schema) if check == CONTENT else []
    try:
        counted = CountedWrite(rows, extra=[*extra, *_blanks(df, shape.partition_by)])
        writer = counted.rows.write.format(provider)
        (writer.partitionBy(*shape.partition_by) if shape.partition_by else writer).save(location)
        found = read_folder(spark, location, df.schema, provider)
        if shape.partition_by:
            _require_no_blanks(shape.partition_by, counted.measured())
        if check == CONTENT:
            of_source = fingerprint_of(counted.measured(), df.schema)
            of_target = fingerprint(found, df.schema)
            require_same_content("the source", of_source, target, of_target)
            counts = Written(of_source.rows, of_target.rows)
        else:
            counts = Written(counted.count(), found.count())
            require_equal("the source", counts.source_count, target, counts.target_count)
        _publish(spark, target, shape, provider, location)
    except Exception:
        if not _reads(spark, target, location):
            delete_folder(spark, location)
        raise
    return counts


def _blanks(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Rows whose partition value no folder can be named after."""
    return [
        F.count_if(F.col(quote(column)).cast("string") == "").alias(f"lakehaul_blank_{at}")
        for at, column in enumerate(columns)
    ]


def _require_no_blanks(columns: Sequence[str], measured: dict) -> None:
    """An empty text would be read back as null."""
    for at, column in enumerate(columns):
        if measured[f"lakehaul_blank_{at}"]:
            raise ValueError(
                f"{measured[f'lakehaul_blank_{at}']} rows have an empty text in partition column {column}"
            )


def register_folder(
    spark: SparkSession,
    target: TableRef,
    path: str,
    schema: StructType,
    provider: str = DEFAULT_PROVIDER,
    renew: bool = False,
) -> bool:
    """An external table over a folder already written; no data is read or copied.

    Only the session catalog has such tables; a catalog with its own format would make
    an empty table there, so it is refused.  An existing table is left alone.  With
    ``renew`` it is declared anew if it reads ``path`` under other columns.  Returns
    whether the table reads ``path``.
    """
    require_file_tables(spark, target)
    if not table_exists(spark, target):
        create_table(spark, target, optional(schema), provider, path)
        return True
    name = table_name(spark, target)
    spark.catalog.refreshTable(name)
    old = details(spark, target)
    if not same_folder(spark, old["location"], path):
        return False
    if renew and old["type"] == "EXTERNAL" and _shape(spark.table(name).schema) != _shape(schema):
        spark.sql(f"DROP TABLE {name}")
        create_table(spark, target, optional(schema), provider, path)
    return True


def require_file_tables(spark: SparkSession, target: TableRef) -> None:
    """Raises if the target's catalog cannot hold a table over plain files."""
    if catalog_name(spark, target.catalog) != quote(SESSION_CATALOG):
        raise ValueError(f"cannot register a folder of files in the catalog of {target}")


def require_reads(spark: SparkSession, target: TableRef, path: str) -> None:
    """Raises if the table exists and reads another folder."""
    if table_exists(spark, target) and not _reads(spark, target, path):
        raise ValueError(f"{target} exists and reads another folder than {path}")


def _reads(spark: SparkSession, target: TableRef, path: str) -> bool:
    return table_exists(spark, target) and same_folder(
        spark, details(spark, target)["location"], path
    )


def _replace_in_plugin(
    df: DataFrame,
    rows: DataFrame,
    target: TableRef,
    provider: str | None,
    shape: TableShape,
    check: str,
) -> Written:
    spark = df.sparkSession
    # Measured before the commit: the rows may come from the target, and where a format
    # shuffles before it writes, repeated tasks would count twice in the writing stage.
    before = fingerprint(df) if check == CONTENT else df.count()
    writer = rows.writeTo(table_name(spark, target))
    if provider:
        writer = writer.using(provider)
    if shape.partition_by:
        writer = writer.partitionedBy(*[F.col(quote(column)) for column in shape.partition_by])
    for key, value in (shape.properties or {}).items():
        writer = writer.tableProperty(key, value)
    writer.createOrReplace()
    found = read_table(spark, target)
    if check == CONTENT:
        after = fingerprint(found, df.schema)
        require_same_content("the source", before, target, after)
        return Written(before.rows, after.rows)
    after = found.count()
    require_equal("the source", before, target, after)
    return Written(before, after)


def _publish(
    spark: SparkSession, target: TableRef, shape: TableShape, provider: str, location: str
) -> None:
    """Points the table at a version folder; metadata only.

    With the same columns and format, and without partitions, which the catalog holds one
    by one, this is one catalog call, and readers never miss the table.  Otherwise the table is
    declared anew, and there is a moment without it; if that fails, the old one comes
    back, as an external table over its files.  Either way the version just replaced stays for
    running readers, and the one before it is deleted.
    """
    name = table_name(spark, target)
    old = details(spark, target) if table_exists(spark, target) else None
    if old is not None and _same_shape(spark, target, old, shape, provider):
        spark.sql(f"ALTER TABLE {name} SET LOCATION {text(location)}")
    elif old is None:
        _declare(spark, target, shape, provider, location)
    else:
        before = table_shape(spark, target)
        _forget(spark, target, old)
        try:
            _declare(spark, target, shape, provider, location)
        except Exception:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            _restore(spark, target, old, before)
            raise
    if old is not None:
        retired = old["location"] if _is_own_folder(spark, target, old) else ""
        set_table_properties(spark, target, {PREVIOUS: retired})
        delete_previous(spark, target, old)


def _declare(
    spark: SparkSession, target: TableRef, shape: TableShape, provider: str, location: str
) -> None:
    """A table over a version folder: managed, unless files lie in its default folder or it has
    partitions, whose folders a managed table would delete when it is declared anew."""
    name = table_name(spark, target)
    managed = not shape.partition_by and is_empty(spark, default_folder(spark, target))
    spark.sql(
        f"CREATE TABLE {name} ({shape.column_list()}) USING {provider}"
        f"{'' if managed else _at(location)}{shape.clauses()}"
    )
    if managed:
        spark.sql(f"ALTER TABLE {name} SET LOCATION {text(location)}")
    if shape.partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def _forget(spark: SparkSession, target: TableRef, old: dict) -> None:
    """Drops a table and leaves its files: a managed one and each of its partitions first read
    an empty folder."""
    name = table_name(spark, target)
    if old["type"] == "MANAGED":
        nowhere = f"{versions_folder(spark, target)}/{uuid.uuid4().hex}"
        spark.sql(f"ALTER TABLE {name} SET LOCATION {text(nowhere)}")
        if old.get("partition_columns"):
            for row in spark.sql(f"SHOW PARTITIONS {name}").toLocalIterator():
                spec = _partition_spec(row["partition"])
                spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION {text(nowhere)}")
    spark.sql(f"DROP TABLE {name}")


def _partition_spec(folder: str) -> str:
    """``a=1/b=x%2Fy`` as the values of a PARTITION clause."""
    pairs = [part.split("=", 1) for part in folder.split("/")]
    return ", ".join(
        f"{quote(unquote(key))} = {'null' if value == NULL_PARTITION else text(unquote(value))}"
        for key, value in pairs
    )


def _restore(spark: SparkSession, target: TableRef, old: dict, shape: TableShape) -> None:
    name = table_name(spark, target)
    spark.sql(
        f"CREATE TABLE {name} ({shape.column_list()}) USING {old['provider']}"
        f"{_at(old['location'])}{shape.clauses()}"
    )
    if shape.partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    kept = old.get("table_properties", {}).get(PREVIOUS)
    if kept:
        set_table_properties(spark, target, {PREVIOUS: kept})


def _is_own_folder(spark: SparkSession, target: TableRef, old: dict) -> bool:
    """True for a version folder or a managed table's folder, not for one a user registered."""
    managed = old["type"] == "MANAGED" and is_default_folder(spark, target, old["location"])
    return managed or is_version(spark, target, old["location"])


def _same_shape(
    spark: SparkSession, target: TableRef, old: dict, shape: TableShape, provider: str
) -> bool:
    if shape.partition_by or old.get("partition_columns") or old.get("bucket_columns"):
        return False
    if old.get("provider", "").lower() != provider.lower():
        return False
    before = table_shape(spark, target)
    # Rows alone say nothing of comments and properties: those of the table stay.
    if shape.properties is None:
        return _shape(before.columns) == _shape(shape.columns)
    return before.declares() == shape.declares()


def _shape(schema: StructType) -> list[tuple[str, str]]:
    """Column names and declared types."""
    return [(field.name, type_text(field)) for field in schema]


def _using(spark: SparkSession, ref: TableRef, provider: str | None) -> str:
    provider = provider or (None if is_plugin(spark, ref.catalog) else DEFAULT_PROVIDER)
    return f" USING {provider}" if provider else ""


def _at(location: str | None) -> str:
    return f" LOCATION {text(location)}" if location else ""
