"""Lake loading and table migration jobs on Spark."""

from lakehaul.names import TableRef

__all__ = ["TableRef"]
