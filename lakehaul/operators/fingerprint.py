"""What a table holds, as a few numbers that do not depend on the order of its rows."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from lakehaul.names import TableRef, quote, table_name
from lakehaul.operators.canonical import canonical, is_plain, with_null_marks
from lakehaul.sources.rows import report_rows

COMPARED = StructType(
    [
        StructField("column_name", StringType()),
        StructField("source_nulls", LongType()),
        StructField("target_nulls", LongType()),
        StructField("same_rows", BooleanType()),
    ]
)


@dataclass(frozen=True)
class Fingerprint:
    """Rows, two sums of row hashes, and the nulls of each column.

    The sums are exact decimals, so equal rows of two tables are counted like any others and
    no pair of differences cancels by overflow.  Equal fingerprints of different contents need
    two 64-bit sums to agree by chance.
    """

    rows: int
    sums: tuple[Decimal, Decimal]
    nulls: dict[str, int]

    def differences(self, other: Fingerprint) -> list[str]:
        """What differs, in words; empty if nothing does."""
        if self == other:
            return []
        told = [f"{self.rows} rows, {other.rows} rows"] if self.rows != other.rows else []
        for column, nulls in self.nulls.items():
            found = other.nulls.get(column)
            if found != nulls:
                told.append(f"column {column}: {nulls} nulls, {found} nulls")
        return told or ["values differ"]


class ContentMismatch(ValueError):
    """A copy holds other rows than its source."""

    def __init__(self, source: object, target: object, differences: list[str]):
        super().__init__(f"{source} and {target} differ: {'; '.join(differences)}")
        self.differences = differences


def fingerprint_columns(schema: StructType) -> list[Column]:
    """Aggregates of one pass; column names as ``schema`` spells them, in its order.

    Maps count by their entries, variants by their JSON text and type, and the two zeros of a
    float as one value.
    """
    parts = []
    for field in schema:
        value = F.col(quote(field.name))
        parts += [value.isNull(), _hashed(value, field.dataType)]
    hashes = [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)") for seed in (0, 1)]
    return [
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(value).alias(f"sum_{at}") for at, value in enumerate(hashes)],
        *[F.count_if(F.col(quote(f.name)).isNull()).alias(f"nulls_{at}") for at, f in enumerate(schema)],
    ]


def fingerprint_of(measured: dict, schema: StructType) -> Fingerprint:
    """From the values of ``fingerprint_columns``."""
    sums = tuple(measured[f"sum_{at}"] or Decimal(0) for at in (0, 1))
    nulls = {field.name: measured[f"nulls_{at}"] for at, field in enumerate(schema)}
    return Fingerprint(measured["rows"], sums, nulls)


def fingerprint(df: DataFrame, schema: StructType | None = None) -> Fingerprint:
    """One scan; ``schema`` gives the order and types to read the columns by."""
    schema = schema or df.schema
    return fingerprint_of(df.agg(*fingerprint_columns(schema)).first().asDict(), schema)


def require_same_content(
    source: object, of_source: Fingerprint, target: object, of_target: Fingerprint
) -> None:
    differences = of_source.differences(of_target)
    if differences:
        raise ContentMismatch(source, target, differences)


def check_contents(spark: SparkSession, source: TableRef, target: TableRef) -> Fingerprint:
    """The fingerprint both tables share; raises ``ContentMismatch`` if they differ.

    Columns are matched by name, whatever their order; a column that only one has, or has in
    another type, is an error before any scan.
    """
    first, second = _both(spark, source, target)
    of_source = fingerprint(first)
    require_same_content(source, of_source, target, fingerprint(second, first.schema))
    return of_source


def compare_contents(spark: SparkSession, source: TableRef, target: TableRef) -> DataFrame:
    """Nulls of both sides per column, and whether all rows are the same."""
    first, second = _both(spark, source, target)
    of_source, of_target = fingerprint(first), fingerprint(second, first.schema)
    rows = [
        (column, nulls, of_target.nulls[column], of_source == of_target)
        for column, nulls in of_source.nulls.items()
    ]
    return report_rows(spark, rows, COMPARED)


def _both(spark: SparkSession, source: TableRef, target: TableRef) -> tuple[DataFrame, DataFrame]:
    first, second = (spark.table(table_name(spark, ref)) for ref in (source, target))
    types = [{f.name: f.dataType.simpleString() for f in side.schema} for side in (first, second)]
    if types[0] != types[1]:
        raise ContentMismatch(source, target, [f"columns {types[0]}, columns {types[1]}"])
    return first, second


def _hashed(value: Column, kind: DataType) -> Column:
    form = kind if is_plain(kind) else _form(kind)
    return with_null_marks(canonical(value, kind), form)


def _form(kind: DataType) -> DataType:
    """The type of a canonical value, as far as nulls inside it matter."""
    if is_plain(kind):
        return kind
    if isinstance(kind, ArrayType):
        return ArrayType(_form(kind.elementType))
    if isinstance(kind, StructType):
        return StructType([StructField(f"_{at}", _form(f.dataType)) for at, f in enumerate(kind)])
    if isinstance(kind, MapType):
        entry = [StructField("key", _form(kind.keyType)), StructField("value", _form(kind.valueType))]
        return ArrayType(StructType(entry))
    return StringType()
