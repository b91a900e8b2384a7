"""DataFrame to DataFrame steps, and counts that ride on a write."""

from lakehaul.operators.columns import empty_like, optional, schema_rows, with_load_time
from lakehaul.operators.canonical import canonical
from lakehaul.operators.counts import (
    CountLost,
    CountMismatch,
    CountedWrite,
    check_counts,
    count_tables,
    try_count_tables,
    row_count,
    row_count_sql,
)
from lakehaul.operators.fingerprint import (
    ContentMismatch,
    Fingerprint,
    check_contents,
    compare_contents,
    fingerprint,
)
from lakehaul.operators.precombine import precombine, require_columns, require_record_keys
from lakehaul.operators.samples import first_rows

__all__ = [
    "ContentMismatch",
    "CountLost",
    "Fingerprint",
    "canonical",
    "check_contents",
    "compare_contents",
    "fingerprint",
    "CountMismatch",
    "CountedWrite",
    "check_counts",
    "count_tables",
    "try_count_tables",
    "empty_like",
    "first_rows",
    "optional",
    "precombine",
    "require_columns",
    "require_record_keys",
    "row_count",
    "row_count_sql",
    "schema_rows",
    "with_load_time",
]
