import pytest

from lakehaul.catalog import list_databases, list_tables, register_view
from lakehaul.names import TableRef
from lakehaul.plans import (
    append_copy,
    catalog_inventory,
    copy_table,
    migrate_database,
    migrate_databases,
    try_copy_table,
)
from lakehaul.sinks import register_folder, replace_table
from lakehaul.sources import read_table
from tests.test_tables import rows


@pytest.fixture
def filled(spark, given, lake):
    """Databases ``one`` (one table unreadable), ``two`` and the empty ``idle``."""
    for table in ("customer", "embeddings"):
        replace_table(given(table), lake.table(table, "one"))
    path = f"{lake.folder}/not_parquet"
    given("supplier").write.csv(path)
    register_folder(spark, lake.table("spoiled", "one"), path, given("supplier").schema)
    replace_table(given("documents"), lake.table("documents", "two"))
    lake.database("idle", lake.source)
    for database in ("one", "two", "idle"):
        lake.database(database, lake.target)
    return lake


def outcome(report) -> list[tuple]:
    return sorted(
        (row.database, row.status, row.table or "", row.source_count, row.dest_count, row.succeeded)
        for row in report.collect()
    )


ONE = [
    ("one", "completed", "customer", 150, 150, True),
    ("one", "completed", "embeddings", 500, 500, True),
    ("one", "completed", "spoiled", None, None, False),
]
TWO = [("two", "completed", "documents", 200, 200, True)]
IDLE = [("idle", "completed", "", None, None, None)]


@pytest.mark.parametrize("parallelism", [1, 4])
def test_all_databases(spark, given, filled, parallelism):
    done = migrate_databases(spark, "*", filled.source, filled.target, parallelism=parallelism)
    assert outcome(done.report) == sorted(IDLE + ONE + TWO)
    durations = {row.database: row for row in done.durations.collect()}
    assert durations["one"][1:5] == ("completed", 3, 2, 1)
    assert durations["idle"][1:5] == ("completed", 0, 0, 0)
    assert all(row.seconds >= 0 for row in durations.values())
    copied = TableRef("one", "embeddings", filled.target)
    assert read_table(spark, copied).schema == given("embeddings").schema
    assert rows(read_table(spark, copied)) == rows(given("embeddings"))


def test_rerun_gives_the_same_tables(spark, filled):
    first = migrate_databases(spark, "*", filled.source, filled.target)
    again = migrate_databases(spark, "*", filled.source, filled.target)
    assert outcome(first.report) == outcome(again.report)
    assert read_table(spark, TableRef("two", "documents", filled.target)).count() == 200


def test_list_with_blanks_and_a_missing_name(spark, filled):
    done = migrate_databases(spark, " two ,missing", filled.source, filled.target)
    skipped = [("missing", "skipped", "", None, None, None)]
    assert outcome(done.report) == skipped + TWO
    reasons = {row.database: row.reason for row in done.report.collect()}
    assert reasons == {"missing": "database not found", "two": None}


def test_failed_table_says_why(spark, filled):
    report = migrate_database(spark, "one", filled.source, filled.target)
    [reason] = [row.reason for row in report.collect() if row.table == "spoiled"]
    assert "not_parquet" in reason


def test_database_that_cannot_be_created_is_failed(spark, filled, monkeypatch):
    create = "lakehaul.plans.migration.create_database"

    def refuse(spark, database, catalog):
        if database == "one":
            raise PermissionError("no right to create one")

    monkeypatch.setattr(create, refuse)
    done = migrate_databases(spark, "one, two", filled.source, filled.target)
    assert outcome(done.report) == [("one", "failed", "", None, None, None), *TWO]
    with pytest.raises(PermissionError):
        migrate_database(spark, "one", filled.source, filled.target)


def test_temporary_views_are_not_copied(spark, given, filled):
    register_view(given("region"), "passing_view")
    try:
        report = migrate_database(spark, "two", filled.source, filled.target)
        assert outcome(report) == TWO
        listed = catalog_inventory(spark, filled.source).where("is_temporary").collect()
        assert {(row.table, row.row_count) for row in listed} == {("passing_view", None)}
    finally:
        spark.catalog.dropTempView("passing_view")


def test_inventory(spark, filled):
    for tables_per_job in (1, 2, 50):
        listed = catalog_inventory(spark, filled.source, tables_per_job)
        found = listed.where("table IS NOT NULL").collect()
        assert [row.table for row in found if row.reason] == ["spoiled"]
        assert sorted(tuple(row)[:4] for row in found) == [
            ("one", "customer", False, 150),
            ("one", "embeddings", False, 500),
            ("one", "spoiled", False, None),
            ("two", "documents", False, 200),
        ]
        idle = listed.where("table IS NULL").collect()
        assert [(row.database, row.reason) for row in idle] == [("idle", None)]
    assert catalog_inventory(spark, "no_such_catalog").count() == 0


def test_copy_replaces_and_append_adds(spark, given, lake):
    source = lake.table("customer")
    replace_table(given("customer"), source)
    replaced = TableRef("fresh", "renamed", lake.target)
    lake.database("fresh", lake.target)
    for _ in range(2):
        assert copy_table(spark, source, replaced) == (150, 150, None)
        assert rows(read_table(spark, replaced)) == rows(given("customer"))
    appended = TableRef("fresh", "appended", lake.target)
    first = append_copy(spark, source, appended)
    assert (first.source_count, first.target_count) == (150, 150)
    assert (first.source_sample.count(), first.target_sample.count()) == (5, 5)
    again = append_copy(spark, source, appended)
    assert (again.source_count, again.target_count) == (150, 300)


def test_copy_in_the_same_catalog_at_a_location(spark, given, lake):
    source, target = lake.table("customer"), lake.table("moved")
    replace_table(given("customer"), source)
    copied = append_copy(spark, source, target, location=f"{lake.folder}/moved")
    assert copied.target_count == 150
    assert spark.read.parquet(f"{lake.folder}/moved").count() == 150


def test_failed_copy_is_a_result_or_an_error(spark, filled):
    source = TableRef("one", "spoiled", filled.source)
    target = TableRef("one", "spoiled", filled.target)
    result = try_copy_table(spark, source, target)
    assert not result.succeeded and result.source_count is None
    with pytest.raises(Exception, match="not_parquet"):
        copy_table(spark, source, target)
    assert [listed.table for listed in list_tables(spark, "one", filled.target)] == []


def test_catalogs_do_not_see_each_other(spark, filled):
    assert sorted(list_databases(spark, filled.source)) == ["idle", "one", "two"]
    assert list_databases(spark, filled.source + "x") == []
