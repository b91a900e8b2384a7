"""What must survive a failure or a mistyped name."""

import pytest

from lakehaul.catalog import create_database, list_databases, table_exists
from lakehaul.catalog.statements import default_folder, details
from lakehaul.names import PREFIXES, TableRef
from lakehaul.plans import csv_to_table, migrate_databases
from lakehaul.sinks import keyed_write, register_folder, replace_table
from lakehaul.sources import read_table


def version_folders(lake, table):
    folder = lake.spark._jvm.java.io.File(f"{lake.folder}/{lake.source}/db/{table}.versions")
    return sorted(folder.list() or [])


def test_external_table_in_the_default_folder_can_be_replaced(spark, given, lake):
    target = lake.table("orders")
    folder = default_folder(spark, target)
    given("orders").write.parquet(folder)
    register_folder(spark, target, folder, given("orders").schema)
    replace_table(given("orders").select("o_orderkey"), target)
    assert read_table(spark, target).columns == ["o_orderkey"]
    assert read_table(spark, target).count() == given("orders").count()
    assert spark.read.parquet(folder).count() == given("orders").count()
    replace_table(given("nation"), target)
    assert read_table(spark, target).count() == given("nation").count()


@pytest.mark.parametrize("partitioned", [False, True])
def test_failed_declaration_leaves_the_old_table(spark, given, lake, monkeypatch, partitioned):
    target = lake.table("events")
    if partitioned:
        folder = f"{lake.folder}/by_status"
        given("orders").write.partitionBy("o_orderstatus").parquet(folder)
        name = f"spark_catalog.`{target.catalog}__{target.database}`.events"
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{folder}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    else:
        replace_table(given("orders"), target)
        replace_table(given("orders"), target)
    before, kept = read_table(spark, target).count(), version_folders(lake, "events")
    assert before == given("orders").count()

    def fails(*args):
        raise OSError("catalog is away")

    monkeypatch.setattr("lakehaul.sinks.tables._declare", fails)
    with pytest.raises(OSError, match="away"):
        replace_table(given("nation"), target)
    assert read_table(spark, target).count() == before
    assert sorted(read_table(spark, target).columns) == sorted(given("orders").columns)
    assert version_folders(lake, "events") == kept
    monkeypatch.undo()
    replace_table(given("nation"), target)
    assert read_table(spark, target).count() == given("nation").count()


def test_readers_keep_their_rows_when_columns_change(spark, given, lake):
    target = lake.table("nation")
    replace_table(given("nation"), target)
    planned = read_table(spark, target)
    replace_table(given("region"), target)
    assert planned.count() == given("nation").count()
    assert details(spark, target)["type"] == "MANAGED"


def test_load_for_a_table_over_another_folder_is_refused(spark, given, lake, tmp_path):
    target, csv = lake.table("loaded"), str(tmp_path / "csv")
    given("nation").write.option("header", True).csv(csv)
    csv_to_table(spark, csv, str(tmp_path / "one"), target)
    with pytest.raises(ValueError, match="another folder"):
        csv_to_table(spark, csv, str(tmp_path / "two"), target)
    assert not (tmp_path / "two").exists()
    with pytest.raises(ValueError, match="another folder"):
        keyed_write(given("nation"), str(tmp_path / "three"), ["n_nationkey"], "n_name", register_as=target)
    assert not (tmp_path / "three").exists()


def test_unknown_catalogs_are_errors(spark, lake):
    lake.table("any")
    spark.conf.set(PREFIXES, "false")
    try:
        for source, target in (("no_such", None), (None, "no_such")):
            with pytest.raises(ValueError, match="no catalog no_such"):
                migrate_databases(spark, "*", source, target)
    finally:
        spark.conf.set(PREFIXES, "true")


def test_a_prefixed_database_belongs_to_one_catalog(spark, lake):
    lake.table("any")
    assert not any("__" in name for name in list_databases(spark))
    assert "db" in list_databases(spark, lake.source)
    with pytest.raises(ValueError, match="cannot hold __"):
        create_database(spark, "deep__x", lake.source)
    with pytest.raises(ValueError, match="cannot hold __"):
        table_exists(spark, TableRef("x", "t", "src__deep"))
