"""One row per record key: the one with the highest ordering value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from lakehaul.names import quote
from lakehaul.operators.canonical import canonical

RANK = "__precombine_rank"


def require_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns as the frame spells them; raises before any work if one is missing."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        spelled = {name: name for name in df.columns}
        found = [spelled.get(name) for name in columns]
    else:
        spelled = {name.lower(): name for name in df.columns}
        found = [spelled.get(name.lower()) for name in columns]
    missing = [name for name, match in zip(columns, found) if match is None]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; have {', '.join(df.columns)}")
    return found


def require_record_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fails the job on a row without any key value.

    All such rows would count as one record, and all but one would be lost.
    """
    keys = require_columns(df, keys)
    no_key = reduce(Column.__and__, [F.col(quote(key)).isNull() for key in keys])
    first = keys[0]
    message = F.lit(f"row without a record key ({', '.join(keys)})")
    checked = F.when(no_key, F.raise_error(message)).otherwise(F.col(quote(first)))
    return df.withColumn(first, checked.cast(df.schema[first].dataType))


def precombine(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """Keeps, per key, the row with the highest ``order_by``; nulls rank last.

    Equal ordering values are settled by ``ties``, highest first.  Without
    ``ties`` all other columns settle them, so the result does not depend on how the
    rows are spread: maps by their entries in key order, variants by their JSON text,
    calendar intervals by months, days and microseconds.  Naming ``ties`` keeps the sort
    key short.

    Spark ranks inside every input partition before the shuffle and sends at most
    one row per key from each, so a hot key costs no more than any other.
    """
    keys = require_columns(df, keys)
    [order_by] = require_columns(df, [order_by])
    if ties is not None:
        ties = require_columns(df, ties)
    else:
        taken = {*keys, order_by}
        ties = [f.name for f in df.schema if f.name not in taken]
    sorted_by = [canonical(F.col(quote(name)), df.schema[name].dataType) for name in (order_by, *ties)]
    ranking = Window.partitionBy(*map(quote, keys)).orderBy(
        *[value.desc_nulls_last() for value in sorted_by]
    )
    ranked = df.withColumn(RANK, F.row_number().over(ranking))
    return ranked.where(F.col(RANK) == 1).drop(RANK)
