from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_time(at: datetime | None = None) -> Column:
    """A constant timestamp, taken once on the driver (default: now)."""
    return F.lit(at or datetime.now())


def insert_time() -> Column:
    """The time the statement starts; every row of one statement gets the same value."""
    return F.current_timestamp()
