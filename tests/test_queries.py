"""Every registered query against its SQL, and what the driver asks of the entry."""

import sys

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from tests.conftest import DATA


@pytest.fixture(scope="module")
def connection():
    return duck(DATA)


def test_every_query_has_its_sql():
    assert entry.QUERIES.keys() == entry.ORACLE.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


# Queries of the optional subpackage have tests of their own beside it.
@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query_gives_what_its_sql_gives(spark, connection, name):
    assert compare(spark, connection, name, DATA) == ""


def test_entry_works_without_the_optional_subpackage(monkeypatch):
    """As with a folder that holds nothing that can be imported."""
    monkeypatch.setitem(sys.modules, "lakehaul.llm.queries", None)
    assert entry.queries().keys() == entry.QUERIES.keys()
    assert entry.oracle_sql() == entry.ORACLE


def test_entry_works_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries()
    assert entry.QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    flagship = entry.entry(spark)
    assert flagship.columns[-1] == "current_date"
    assert flagship.count() == 1500
