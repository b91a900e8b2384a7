from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakehaul.names import TableRef, quote, table_name


def read_table(spark: SparkSession, ref: TableRef) -> DataFrame:
    """A table by name; the catalog knows its format."""
    return spark.table(table_name(spark, ref))


def read_sql(spark: SparkSession, ref: TableRef) -> DataFrame:
    """The same scan as a SQL statement."""
    return spark.sql(f"SELECT * FROM {table_name(spark, ref)}")


def read_view(spark: SparkSession, view: str) -> DataFrame:
    """A temporary view of this session."""
    return spark.table(quote(view))
