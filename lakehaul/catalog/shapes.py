"""What a table declares beside its rows: columns, partitions, comments, defaults, properties."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from lakehaul.catalog.statements import details
from lakehaul.names import TableRef, is_plugin, quote, table_name, text

# Where Spark keeps the declared type of a CHAR or VARCHAR column, and a column's default.
TEXT_LENGTH, DEFAULT = "__CHAR_VARCHAR_TYPE_STRING", "CURRENT_DEFAULT"
# Properties of the library itself, which belong to one table.
OWN = "lakehaul."


class TableShape(NamedTuple):
    """Columns carry comments, defaults and text lengths in their metadata."""

    columns: StructType
    partition_by: tuple[str, ...] = ()
    comment: str | None = None
    properties: dict[str, str] | None = None

    def column_list(self) -> str:
        """The columns as a CREATE TABLE statement names them."""
        return ", ".join(_column(field) for field in self.columns)

    def clauses(self) -> str:
        """Partitions, comment and properties of a CREATE TABLE statement."""
        parts = f" PARTITIONED BY ({', '.join(map(quote, self.partition_by))})" if self.partition_by else ""
        comment = f" COMMENT {text(self.comment)}" if self.comment else ""
        pairs = ", ".join(f"{text(k)} = {text(v)}" for k, v in (self.properties or {}).items())
        return parts + comment + (f" TBLPROPERTIES ({pairs})" if pairs else "")

    def declares(self) -> tuple:
        """All that two tables share if they are described alike."""
        columns = [
            (f.name, type_text(f), f.metadata.get("comment"), f.metadata.get(DEFAULT)) for f in self.columns
        ]
        return columns, self.partition_by, self.comment or None, self.properties or {}


def table_shape(spark: SparkSession, ref: TableRef) -> TableShape:
    """The shape of a table.

    Of a plug-in catalog's table the properties stay behind: most of them are its format's own.
    """
    name = table_name(spark, ref)
    columns = spark.table(name).schema
    if is_plugin(spark, ref.catalog):
        return TableShape(columns, partition_columns(spark, ref))
    told = details(spark, ref)
    parts = tuple(told.get("partition_columns") or ())
    kept = {k: v for k, v in told.get("table_properties", {}).items() if not k.startswith(OWN)}
    return TableShape(columns, parts, told.get("comment"), kept)


def partition_columns(spark: SparkSession, ref: TableRef) -> tuple[str, ...]:
    """Columns that name the partitions of a table as they are, in their order."""
    columns = spark.catalog.listColumns(table_name(spark, ref))
    return tuple(column.name for column in columns if column.isPartition)


def described(spark: SparkSession, ref: TableRef) -> DataFrame:
    """One row per column: ``column_name``, ``data_type``, ``comment``, ``default_value`` and
    ``is_partition``."""
    shape = table_shape(spark, ref)
    rows = [
        (f.name, type_text(f), f.metadata.get("comment"), f.metadata.get(DEFAULT), f.name in shape.partition_by)
        for f in shape.columns
    ]
    return spark.createDataFrame(
        rows, "column_name string, data_type string, comment string, default_value string, is_partition boolean"
    )


def type_text(field: StructField) -> str:
    """The declared type; CHAR and VARCHAR, plain text to a frame, keep their length."""
    return field.metadata.get(TEXT_LENGTH) or field.dataType.simpleString()


def _column(field: StructField) -> str:
    # Spark's own text of a nested type quotes the names inside it.
    kind = field.metadata.get(TEXT_LENGTH) or StructType([StructField("c", field.dataType)]).toDDL()[2:]
    default = field.metadata.get(DEFAULT)
    comment = field.metadata.get("comment")
    return (
        f"{quote(field.name)} {kind}"
        f"{'' if field.nullable else ' NOT NULL'}"
        f"{f' DEFAULT {default}' if default else ''}"
        f"{f' COMMENT {text(comment)}' if comment else ''}"
    )
