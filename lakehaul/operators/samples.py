from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def first_rows(
    df: DataFrame, n: int = 20, order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """The first ``n`` rows; which ones is only fixed when ``order_by`` is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
