"""What a migration has finished, kept in a folder that outlives the driver.

Every finished table is one entry, a Parquet folder of its own inside the ledger's folder, so
entries never touch each other: threads and drivers may append at the same time, and on an
object store nothing is renamed over anything.  An entry counts once it is whole.  The
latest entry of a table is what counts, and a repeated migration leaves out what succeeded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from lakehaul.operators.precombine import precombine
from lakehaul.sources.rows import report_rows
from lakehaul.storage import folder_exists

ENTRY = StructType(
    [
        StructField("source_catalog", StringType()),
        StructField("target_catalog", StringType()),
        StructField("database", StringType()),
        StructField("table", StringType()),
        StructField("source_count", LongType()),
        StructField("dest_count", LongType()),
        StructField("succeeded", BooleanType()),
        StructField("reason", StringType()),
        StructField("started", DoubleType()),
        StructField("finished", DoubleType()),
        StructField("entry", StringType()),
    ]
)


class Ledger:
    """The finished tables of one source and one target catalog, in ``folder``.

    Several migrations may share a folder: each sees the entries of its own two catalogs.
    """

    def __init__(
        self, spark: SparkSession, folder: str, source_catalog: str | None, target_catalog: str | None
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.catalogs = (source_catalog, target_catalog)

    def append(
        self,
        database: str,
        table: str,
        counts: tuple[int | None, int | None],
        error: str | None,
        started: float,
        finished: float,
    ) -> None:
        """One more entry; durable when this returns."""
        entry = uuid.uuid4().hex
        row = (*self.catalogs, database, table, *counts, error is None, error, started, finished, entry)
        report_rows(self.spark, [row], ENTRY).coalesce(1).write.parquet(f"{self.folder}/{entry}")

    def entries(self) -> DataFrame:
        """All entries of these catalogs; an entry that is only half written is not there yet."""
        if not folder_exists(self.spark, self.folder):
            return report_rows(self.spark, [], ENTRY)
        source, target = (F.lit(catalog).cast("string") for catalog in self.catalogs)
        return (
            self.spark.read.schema(ENTRY)
            .option("recursiveFileLookup", "true")
            .parquet(self.folder)
            .where(F.col("source_catalog").eqNullSafe(source) & F.col("target_catalog").eqNullSafe(target))
        )

    def latest(self) -> DataFrame:
        """The last entry of each table."""
        return precombine(self.entries(), ["database", "table"], "finished", ties=["entry"])

    def finished(self) -> dict[tuple[str, str], Row]:
        """The last entry of every table whose last copy succeeded, by database and table."""
        rows = self.latest().where("succeeded").collect()
        return {(row["database"], row["table"]): row for row in rows}
