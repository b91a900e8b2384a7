"""Values of any type in a form that has an order and a hash.

Maps, variants and calendar intervals have no order in Spark, and maps and variants no hash.
Here a map becomes its entries in the order of their keys, a variant its JSON text and its
type, an interval its months, days and microseconds; arrays and structs are rebuilt around
them.  Equal values have equal forms, however a map's entries were written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    CalendarIntervalType,
    DataType,
    MapType,
    StructType,
    VariantType,
)


def is_plain(kind: DataType) -> bool:
    """True if Spark itself can order and hash the type."""
    if isinstance(kind, (MapType, VariantType, CalendarIntervalType)):
        return False
    if isinstance(kind, ArrayType):
        return is_plain(kind.elementType)
    if isinstance(kind, StructType):
        return all(is_plain(field.dataType) for field in kind)
    return True


def canonical(value: Column, kind: DataType) -> Column:
    """The same value in a form that can be ordered and hashed."""
    if is_plain(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: canonical(item, kind.elementType))
    if isinstance(kind, StructType):
        fields = [canonical(value.getField(f.name), f.dataType).alias(f"_{at}") for at, f in enumerate(kind)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda entry: F.struct(
                canonical(entry["key"], kind.keyType).alias("key"),
                canonical(entry["value"], kind.valueType).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(kind, VariantType):
        parts = F.struct(F.to_json(value).alias("json"), F.schema_of_variant(value).alias("type"))
        return F.when(value.isNotNull(), parts)
    months = F.extract(F.lit("YEAR"), value) * 12 + F.extract(F.lit("MONTH"), value)
    hours = F.extract(F.lit("HOUR"), value).cast("bigint")
    minutes = hours * 60 + F.extract(F.lit("MINUTE"), value)
    micros = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    parts = F.struct(
        months.alias("months"), F.extract(F.lit("DAY"), value).alias("days"), (minutes * 60_000_000 + micros).alias("micros")
    )
    return F.when(value.isNotNull(), parts)


def with_null_marks(value: Column, kind: DataType) -> Column:
    """A canonical value whose inner nulls count in a hash, which skips them otherwise."""
    if isinstance(kind, ArrayType):
        return F.transform(
            value,
            lambda item: F.struct(item.isNull().alias("null"), with_null_marks(item, kind.elementType).alias("item")),
        )
    if isinstance(kind, StructType):
        marked = [
            part
            for f in kind
            for part in (
                value.getField(f.name).isNull().alias(f"{f.name}_null"),
                with_null_marks(value.getField(f.name), f.dataType).alias(f.name),
            )
        ]
        return F.when(value.isNotNull(), F.struct(*marked))
    return value
