"""Which calls a catalog with its own table format gets.

No such catalog ships with Spark, so the frames here only record what is asked of
them; the SQL is recorded in the same way.
"""

import pytest
from pyspark.sql.types import StructType

from lakehaul.catalog import create_database, drop_tables
from lakehaul.names import TableRef
from lakehaul.operators import CountMismatch
from lakehaul.sinks import (
    append_table,
    clone_empty,
    create_table,
    register_folder,
    replace_table,
)

TARGET = TableRef("db", "t", "lake")
NAME = "`lake`.`db`.`t`"
COUNT = "lakehaul.operators.counts.CountedWrite.count"


class RecordingFrame:
    schema = StructType()

    def __init__(self, session, rows: int):
        self.sparkSession, self.rows, self.calls = session, rows, session.calls

    def observe(self, observation, *metrics):
        observation._jo = object()
        return self

    def count(self):
        return self.rows

    def writeTo(self, name):
        self.calls.append(("writeTo", name))
        return self

    def using(self, provider):
        self.calls.append(("using", provider))
        return self

    def createOrReplace(self):
        self.calls.append("createOrReplace")

    def append(self):
        self.calls.append("append")


class RecordingSession:
    """The real session for settings; a list for what would change a catalog."""

    def __init__(self, spark, rows_found: int):
        self.conf, self.calls, self.rows_found = spark.conf, [], rows_found
        self.catalog = self

    def currentCatalog(self):
        return "spark_catalog"

    def tableExists(self, name):
        return False

    def listColumns(self, name):
        return []

    def sql(self, statement, args=None):
        self.calls.append(" ".join(statement.split()))

    def table(self, name):
        return RecordingFrame(self, self.rows_found)


@pytest.fixture
def session(spark, monkeypatch):
    spark.conf.set("spark.sql.catalog.lake", "some.Catalog")
    # What is recorded here is never run, so no count arrives with the write.
    monkeypatch.setattr(COUNT, lambda self: self.rows.count())
    yield lambda rows_found: RecordingSession(spark, rows_found)
    spark.conf.unset("spark.sql.catalog.lake")


def test_replace_is_the_catalogs_own(session):
    recording = session(rows_found=3)
    assert replace_table(RecordingFrame(recording, 3), TARGET, "iceberg") == (3, 3)
    assert recording.calls == [("writeTo", NAME), ("using", "iceberg"), "createOrReplace"]


def test_without_a_provider_the_catalog_chooses(session):
    recording = session(rows_found=3)
    replace_table(RecordingFrame(recording, 3), TARGET)
    assert recording.calls == [("writeTo", NAME), "createOrReplace"]


def test_replace_compares_the_counts(session):
    recording = session(rows_found=2)
    with pytest.raises(CountMismatch, match="3 rows.*2"):
        replace_table(RecordingFrame(recording, 3), TARGET)


def test_replace_counts_before_the_commit_and_without_events(session, monkeypatch):
    monkeypatch.delattr(COUNT)
    recording, order = session(rows_found=3), []
    source = RecordingFrame(recording, 3)
    monkeypatch.setattr(source, "count", lambda: order.append(len(recording.calls)) or 3)
    assert replace_table(source, TARGET) == (3, 3)
    assert order == [0]


def test_append_is_the_catalogs_own(session):
    recording = session(rows_found=6)
    assert append_table(RecordingFrame(recording, 3), TARGET) == 3
    assert recording.calls == [("writeTo", NAME), "append"]


def test_a_folder_of_files_is_not_registered(session, given):
    recording = session(rows_found=0)
    with pytest.raises(ValueError, match="lake.db.t"):
        register_folder(recording, TARGET, "s3://bucket/t", given("nation").schema)
    assert recording.calls == []


def test_statements_name_the_catalog(session):
    recording = session(rows_found=0)
    create_database(recording, "db", "lake")
    create_table(recording, TARGET, "id INT", "iceberg", "s3://bucket/t")
    clone_empty(recording, TableRef("db", "s", "lake"), TARGET, "iceberg")
    drop_tables(recording, [TARGET])
    assert recording.calls == [
        "CREATE NAMESPACE IF NOT EXISTS `lake`.`db`",
        f"CREATE TABLE IF NOT EXISTS {NAME} (id INT) USING iceberg LOCATION 's3://bucket/t'",
        f"CREATE TABLE IF NOT EXISTS {NAME} USING iceberg"
        " AS SELECT * FROM `lake`.`db`.`s` WHERE 1 = 0",
        f"DROP TABLE IF EXISTS {NAME}",
    ]
