import os

import pytest
from pyspark.sql import functions as F

from lakehaul.catalog import (
    create_database,
    describe_table,
    drop_database,
    drop_tables,
    list_databases,
    list_tables,
    register_view,
    set_current_database,
    set_table_properties,
    table_exists,
    table_properties,
)
from lakehaul.catalog.statements import PREVIOUS, details
from lakehaul.names import database_name, table_name
from lakehaul.operators import CountMismatch, check_counts, count_tables
from lakehaul.plans import create_append_read, create_insert_read, keyed_load
from lakehaul.sinks import (
    append_table,
    clone_empty,
    create_table,
    insert_values,
    keyed_replace,
    keyed_write,
    register_folder,
    replace_table,
)
from lakehaul.sources import read_folder, read_sql, read_table
from tests.conftest import CHANGE_COLUMNS, CHANGES


def rows(df) -> list[tuple]:
    return sorted(tuple(row) for row in df.collect())


def broken(spark, given):
    """Fails while it is read."""
    return given("orders").withColumn(
        "o_orderstatus",
        F.when(F.col("o_orderkey") >= 0, F.raise_error(F.lit("cannot read"))),
    )


def versions(lake, table: str, catalog: str | None = None) -> list[str]:
    folder = f"{lake.folder}/{catalog or lake.source}/db/{table}.versions"
    return os.listdir(folder) if os.path.isdir(folder) else []


def test_create_append_read(changes, lake):
    target = lake.table("changes")
    first = create_append_read(changes, target, CHANGE_COLUMNS)
    assert (first.rows, rows(first.data)) == (4, sorted(CHANGES))
    again = create_append_read(changes, target, CHANGE_COLUMNS)
    assert (again.rows, again.data.count()) == (4, 8)


def test_create_insert_read(spark, lake):
    target = lake.table("typed")
    read = create_insert_read(
        spark,
        target,
        "code BIGINT, label STRING, added TIMESTAMP",
        "(1, :name, current_timestamp()), (2, 'plain', current_timestamp())",
        {"name": "it's"},
    )
    assert rows(read.select("code", "label")) == [(1, "it's"), (2, "plain")]
    assert read.select("added").distinct().count() == 1
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        create_table(spark, target, "id INT", if_not_exists=False)


def test_column_named_like_a_function(spark, lake):
    target = lake.table("trips")
    create_table(spark, target, "trip string, day string, current_date string")
    insert_values(spark, target, "('1', '2024-01-01', 'later')")
    assert rows(read_sql(spark, target).select("current_date")) == [("later",)]


def test_append_matches_columns_by_name(spark, changes, lake):
    target = lake.table("changes")
    create_table(spark, target, CHANGE_COLUMNS)
    append_table(changes.select("last_update_time", "id", "creation_date"), target)
    assert rows(read_table(spark, target)) == sorted(CHANGES)
    with pytest.raises(ValueError, match="has columns"):
        append_table(changes.drop("id"), target)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        append_table(changes.withColumnRenamed("id", "key"), target)


@pytest.mark.parametrize("table", ["part", "embeddings", "documents", "events"])
def test_empty_clone_has_the_same_schema(spark, given, lake, table):
    source, target = lake.table(table), lake.table("clone")
    replace_table(given(table), source)
    clone_empty(spark, source, target)
    assert read_table(spark, target).schema == given(table).schema
    assert read_table(spark, target).count() == 0


def test_empty_clone_at_a_location(spark, given, lake):
    source, target = lake.table("part"), lake.table("clone")
    replace_table(given("part"), source)
    clone_empty(spark, source, target, location=f"{lake.folder}/clone")
    append_table(given("part"), target)
    assert rows(read_folder(spark, f"{lake.folder}/clone")) == rows(given("part"))
    clone_empty(spark, source, target)
    assert read_table(spark, target).count() == 200
    with pytest.raises(ValueError, match="holds files"):
        clone_empty(spark, source, lake.table("other"), location=f"{lake.folder}/clone")
    assert read_table(spark, target).count() == 200


def test_replace_gives_the_same_table_each_time(spark, given, lake):
    target = lake.table("orders")
    for _ in range(4):
        assert replace_table(given("orders"), target) == (1500, 1500)
        assert rows(read_table(spark, target)) == rows(given("orders"))
    # The present version, and the one before it for readers that still run.
    assert len(versions(lake, "orders")) == 2
    assert [listed.table for listed in list_tables(spark, "db", lake.source)] == ["orders"]


def test_replace_with_other_columns(spark, given, lake):
    target = lake.table("mixed")
    for table in ("customer", "customer", "supplier", "nation"):
        replace_table(given(table), target)
        assert rows(read_table(spark, target)) == rows(given(table))
    # The present version and, for running readers, the one before: no more.
    assert len(versions(lake, "mixed")) == 2


def test_replace_of_a_managed_table_filled_by_append(spark, given, lake):
    target = lake.table("orders")
    create_append_read(given("orders"), target)
    for times in (2, 4, 8):
        double = read_table(spark, target)
        replace_table(double.unionAll(double), target)
        assert read_table(spark, target).count() == times * 1500
    drop_tables(spark, [target])
    create_append_read(given("orders"), target)
    assert read_table(spark, target).count() == 1500


def test_replace_forgets_statistics_and_text_lengths(spark, given, lake):
    target = lake.table("nation")
    create_table(spark, target, "n_nationkey INT, n_name CHAR(40), n_regionkey INT")
    append_table(given("nation"), target)
    replace_table(given("nation"), target)
    assert rows(read_table(spark, target)) == rows(given("nation"))
    spark.sql(f"ANALYZE TABLE {table_name(spark, target)} COMPUTE STATISTICS")
    assert details(spark, target)["statistics"]["num_rows"] == 25
    replace_table(given("nation").limit(3), target)
    assert "statistics" not in details(spark, target)


def test_text_of_limited_length_is_copied_as_text(spark, lake):
    source, target = lake.table("codes"), lake.table("copy")
    create_table(spark, source, "code CHAR(4), name VARCHAR(9)")
    insert_values(spark, source, "('ab', 'alpha'), ('cdef', 'beta')")
    for _ in range(2):
        replace_table(read_table(spark, source), target)
        assert rows(read_table(spark, target)) == [("ab  ", "alpha"), ("cdef", "beta")]
    # Same shape the second time: the table was pointed at another version, not dropped.
    assert len(versions(lake, "copy")) == 2


def test_partitioned_target_is_replaced_whole(spark, given, lake):
    target = lake.table("orders")
    name = table_name(spark, target)
    lake.database("db", lake.source)
    given("orders").write.partitionBy("o_orderstatus").saveAsTable(name)
    replace_table(given("orders"), target)
    replace_table(given("orders"), target)
    assert rows(read_table(spark, target)) == rows(given("orders"))


def test_running_readers_keep_the_replaced_version(spark, given, lake):
    target = lake.table("orders")
    replace_table(given("orders"), target)
    planned = read_table(spark, target)
    replace_table(given("orders").limit(10), target)
    assert (planned.count(), read_table(spark, target).count()) == (1500, 10)


def test_failed_write_keeps_the_old_table(spark, given, lake):
    target = lake.table("orders")
    replace_table(given("orders"), target)
    kept = versions(lake, "orders")
    with pytest.raises(Exception, match="cannot read"):
        replace_table(broken(spark, given), target)
    assert rows(read_table(spark, target)) == rows(given("orders"))
    assert versions(lake, "orders") == kept


def test_failed_check_keeps_the_old_table(spark, given, lake, monkeypatch):
    target = lake.table("orders")
    replace_table(given("orders"), target)
    kept = versions(lake, "orders")
    monkeypatch.setattr("lakehaul.sinks.tables.CountedWrite.count", lambda self: 7)
    with pytest.raises(CountMismatch, match="7 rows"):
        replace_table(given("orders").limit(3), target)
    assert read_table(spark, target).count() == 1500
    assert versions(lake, "orders") == kept


def test_replace_never_deletes_a_registered_folder(spark, given, lake):
    target, path = lake.table("orders"), f"{lake.folder}/mine"
    given("orders").write.parquet(path)
    assert register_folder(spark, target, path, given("orders").schema)
    for _ in range(3):
        replace_table(given("orders").limit(5), target)
    drop_tables(spark, [target])
    assert read_folder(spark, path).count() == 1500


def test_register_folder_leaves_an_existing_table_alone(spark, given, lake):
    target = lake.table("orders")
    given("orders").write.parquet(f"{lake.folder}/one")
    given("orders").limit(1).write.parquet(f"{lake.folder}/two")
    schema = given("orders").schema
    assert register_folder(spark, target, f"{lake.folder}/one", schema)
    assert register_folder(spark, target, f"{lake.folder}/one", schema)
    assert not register_folder(spark, target, f"{lake.folder}/two", schema)
    assert read_table(spark, target).count() == 1500


def test_required_columns_become_optional(spark, lake):
    target = lake.table("ids")
    replace_table(spark.range(10), target)
    insert_values(spark, target, "(NULL)")
    assert read_table(spark, target).where("id IS NULL").count() == 1


def test_other_file_format(spark, given, lake):
    target = lake.table("orders")
    replace_table(given("orders"), target, provider="orc")
    replace_table(given("orders"), target, provider="orc")
    assert details(spark, target)["provider"] == "orc"
    append_table(given("orders"), target)
    assert read_table(spark, target).count() == 3000
    replace_table(given("orders"), target)
    assert details(spark, target)["provider"] == "parquet"
    assert rows(read_table(spark, target)) == rows(given("orders"))


def test_databases_and_tables(spark, given, lake):
    for database in ("one", "two"):
        lake.database(database, lake.source)
        create_database(spark, database, lake.source)
    assert sorted(list_databases(spark, lake.source)) == ["one", "two"]
    assert list_databases(spark, lake.target) == []
    replace_table(given("nation"), lake.table("nation", "one"))
    register_view(given("region"), "some_view")
    assert sorted(list_tables(spark, "one", lake.source)) == [
        ("nation", False), ("some_view", True),
    ]
    spark.catalog.dropTempView("some_view")
    set_current_database(spark, "one", lake.source)
    assert spark.sql("SELECT count(*) FROM nation").collect() == [(25,)]
    spark.sql("USE default")
    drop_database(spark, "one", lake.source, cascade=True)
    drop_database(spark, "two", lake.source)
    drop_database(spark, "two", lake.source)
    assert list_databases(spark, lake.source) == []


def test_dropped_tables_leave_no_files(spark, given, lake):
    target = lake.table("orders")
    for _ in range(2):
        replace_table(given("orders"), target)
    drop_tables(spark, [target, lake.table("never_there")])
    assert not table_exists(spark, target)
    assert versions(lake, "orders") == []


def test_properties_and_description(spark, given, lake):
    target = lake.table("orders")
    replace_table(given("orders"), target)
    set_table_properties(spark, target, {"write.format.default": "it's"})
    found = {row.key: row.value for row in table_properties(spark, target).collect()}
    assert found["write.format.default"] == "it's"
    described = {row.col_name: row.data_type for row in describe_table(spark, target).collect()}
    assert described["o_orderkey"] == "bigint"
    assert described["Provider"] == "parquet"


def test_names_with_odd_characters(spark, given, lake):
    lake.database("db", lake.source)
    rows_before = given("nation").withColumnRenamed("n_name", "a `name`, with; marks")
    target = lake.table("nation")
    replace_table(rows_before, target)
    append_table(rows_before, target)
    assert read_table(spark, target).columns[1] == "a `name`, with; marks"
    assert read_table(spark, target).count() == 50
    assert database_name(spark, "a`b", "c") == "`spark_catalog`.`c__a``b`"


def test_counts_of_many_tables(spark, given, lake):
    refs = []
    for table in ("nation", "orders", "region"):
        refs.append(lake.table(table))
        replace_table(given(table), refs[-1])
    missing = lake.table("missing")
    assert count_tables(spark, refs) == [25, 1500, 5]
    assert count_tables(spark, refs, tables_per_job=2) == [25, 1500, 5]
    assert count_tables(spark, [refs[0], missing, refs[1]]) == [25, None, 1500]
    assert count_tables(spark, []) == []
    assert check_counts(spark, refs[0], refs[0]) == 25
    with pytest.raises(CountMismatch, match="25 rows.*1500"):
        check_counts(spark, refs[0], refs[1])


def test_keyed_write_replaces_earlier_rows(spark, changes, lake):
    target, path = lake.table("keyed"), f"{lake.folder}/keyed"
    loaded = keyed_load(changes, path, ["id"], "last_update_time", register_as=target)
    assert loaded.rows == 3
    assert rows(loaded.data) == sorted([CHANGES[0], CHANGES[2], CHANGES[3]])
    assert rows(read_table(spark, target)) == rows(loaded.data)
    later = changes.where("id = 'pump-b'")
    keyed_load(later, path, ["id"], "last_update_time", register_as=target)
    assert rows(read_table(spark, target)) == [CHANGES[2]]


def test_keyed_write_checks_its_columns_first(spark, changes, lake):
    path = f"{lake.folder}/keyed"
    keyed_write(changes, path, ["id"], "last_update_time")
    with pytest.raises(ValueError, match="checksum"):
        keyed_write(changes, path, ["id", "checksum"], "ts")
    assert read_folder(spark, path).count() == 3


def test_keyed_write_with_other_columns_renews_the_table(spark, changes, lake):
    target, path = lake.table("keyed"), f"{lake.folder}/keyed"
    keyed_write(changes, path, ["id"], "last_update_time", register_as=target)
    wider = changes.withColumn("source", F.lit("crm"))
    keyed_write(wider, path, ["id"], "last_update_time", register_as=target)
    assert read_table(spark, target).columns == wider.columns
    assert read_table(spark, target).where("source = 'crm'").count() == 3


def test_a_stray_property_deletes_nothing(spark, given, lake):
    """The folder named by a copied property belongs to another table."""
    one, two = lake.table("one"), lake.table("two")
    replace_table(given("nation"), one)
    replace_table(given("nation"), two)
    set_table_properties(spark, two, {PREVIOUS: details(spark, one)["location"]})
    replace_table(given("nation"), two)
    set_table_properties(spark, two, {PREVIOUS: details(spark, two)["location"]})
    replace_table(given("nation"), two)
    assert read_table(spark, one).count() == read_table(spark, two).count() == 25
    set_table_properties(spark, two, {PREVIOUS: details(spark, one)["location"]})
    drop_tables(spark, [two])
    assert read_table(spark, one).count() == 25


def test_keyed_write_may_read_its_own_folder(spark, given, lake):
    path = f"{lake.folder}/keyed"
    given("orders").write.parquet(path)
    keyed_write(read_folder(spark, path), path, ["o_orderkey"], "o_orderdate")
    assert rows(read_folder(spark, path)) == rows(given("orders"))
    assert sorted(os.listdir(lake.folder)) == ["keyed"]


def test_failed_keyed_write_keeps_the_old_rows(spark, given, lake):
    path = f"{lake.folder}/keyed"
    keyed_write(given("orders"), path, ["o_orderkey"], "o_orderdate")
    with pytest.raises(Exception, match="cannot read"):
        keyed_write(broken(spark, given), path, ["o_orderkey"], "o_orderdate")
    assert rows(read_folder(spark, path)) == rows(given("orders"))
    assert sorted(os.listdir(lake.folder)) == ["keyed"]


def test_keyed_write_registers_only_its_own_folder(spark, changes, lake):
    target = lake.table("keyed")
    keyed_write(changes, f"{lake.folder}/a", ["id"], "last_update_time", register_as=target)
    with pytest.raises(ValueError, match="another folder"):
        keyed_write(changes, f"{lake.folder}/b", ["id"], "last_update_time", register_as=target)


def test_keyed_replace(spark, changes, lake):
    target = lake.table("keyed")
    assert keyed_replace(changes, target, ["id"], "last_update_time") == (3, 3)
    assert keyed_replace(changes, target, ["id"], "last_update_time") == (3, 3)
    nameless = changes.withColumn("id", F.nullif("id", F.lit("pump-b")))
    with pytest.raises(Exception, match="without a record key"):
        keyed_replace(nameless, target, ["id"], "last_update_time")
    assert read_table(spark, target).count() == 3
