from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    LongType,
    StringType,
    StructType,
)

# Column types that reports use.
ARROW_TYPES: dict[DataType, pa.DataType] = {
    StringType(): pa.string(),
    LongType(): pa.int64(),
    DoubleType(): pa.float64(),
    BooleanType(): pa.bool_(),
}


def literal_rows(
    spark: SparkSession,
    rows: Sequence[tuple],
    columns: Sequence[str] | str | StructType,
) -> DataFrame:
    """Rows written out in the program: column names alone, or a schema."""
    columns = columns if isinstance(columns, (str, StructType)) else list(columns)
    return spark.createDataFrame(list(rows), columns)


def report_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """Names, statuses and counts gathered on the driver, as a local relation.

    Built from Arrow, so that reading a report starts no Python worker.
    """
    columns = [
        pa.array([row[at] for row in rows], ARROW_TYPES[field.dataType])
        for at, field in enumerate(schema)
    ]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)
