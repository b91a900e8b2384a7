from __future__ import annotations

import uuid

import pytest

from lakehaul.catalog import create_database
from lakehaul.names import PREFIXES, TableRef
from tests.session import local_session

DATA = "/root/testdata/sf0.001"
# Change rows of which one id comes twice.
CHANGES = [
    ("pump-a", "2023-03-01", "2023-03-09T06:00:00.5Z"),
    ("pump-a", "2023-03-01", "2023-03-08T23:30:00.25Z"),
    ("pump-b", "2023-03-02", "2023-03-10T00:00:01Z"),
    ("pump-c", "2023-03-04", "2023-03-05T17:45:12Z"),
]
CHANGE_COLUMNS = "id string, creation_date string, last_update_time string"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def given(spark):
    return lambda table: spark.read.parquet(f"{DATA}/{table}.parquet")


@pytest.fixture
def changes(spark):
    return spark.createDataFrame(CHANGES, CHANGE_COLUMNS)


class Lake:
    """Databases in a temporary folder, under catalog names of their own."""

    def __init__(self, spark, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set(PREFIXES, "true")
        self.source = f"src_{uuid.uuid4().hex[:8]}"
        self.target = f"dst_{uuid.uuid4().hex[:8]}"

    def database(self, name: str, catalog: str) -> str:
        create_database(self.spark, name, catalog, f"{self.folder}/{catalog}/{name}")
        return name

    def table(self, name: str, database: str = "db", catalog: str | None = None) -> TableRef:
        catalog = catalog or self.source
        return TableRef(self.database(database, catalog), name, catalog)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path))
