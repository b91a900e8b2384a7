from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from lakehaul.functions import load_time
from lakehaul.sources.rows import report_rows

SCHEMA_ROWS = StructType(
    [
        StructField("column_name", StringType()),
        StructField("data_type", StringType()),
        StructField("nullable", BooleanType()),
    ]
)


def with_load_time(
    df: DataFrame, at: datetime | None = None, column: str = "current_date"
) -> DataFrame:
    """Adds the load time, one constant for all rows (default: now)."""
    return df.withColumn(column, load_time(at))


def empty_like(df: DataFrame) -> DataFrame:
    """Same columns, no rows; the optimizer drops the scan."""
    return df.where(F.lit(False))


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema, one row per column, without touching the data."""
    return report_rows(
        df.sparkSession,
        [(field.name, field.dataType.simpleString(), field.nullable) for field in df.schema],
        SCHEMA_ROWS,
    )


def optional(kind: DataType) -> DataType:
    """The same type with nulls allowed everywhere, as tables made from queries have it."""
    if isinstance(kind, StructType):
        return StructType(
            [StructField(f.name, optional(f.dataType), True, f.metadata) for f in kind]
        )
    if isinstance(kind, ArrayType):
        return ArrayType(optional(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(optional(kind.keyType), optional(kind.valueType))
    return kind
