"""Column expressions."""

from lakehaul.functions.times import insert_time, load_time

__all__ = ["insert_time", "load_time"]
