"""Copies keep what their source declares; file sizes."""

import pathlib
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from lakehaul.catalog import described, partition_columns, set_table_properties, table_shape
from lakehaul.operators import check_contents
from lakehaul.plans import append_copy, copy_table
from lakehaul.sinks import CONTENT, append_table, create_table, replace_table, write_folder
from lakehaul.sources import read_table
from tests.test_tables import rows


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def source(lake, given):
    table = lake.table("lines")
    replace_table(given("lineitem"), table, partition_by=["l_returnflag"])
    return table


def test_a_copy_is_partitioned_as_its_source(spark, given, lake, source):
    target = lake.table("lines", catalog=lake.target)
    for _ in range(3):
        assert copy_table(spark, source, target, check=CONTENT).succeeded
    assert partition_columns(spark, target) == ("l_returnflag",)
    assert rows(read_table(spark, target).select(given("lineitem").columns)) == rows(given("lineitem"))
    plan = plan_of(read_table(spark, target).where("l_returnflag = 'R'"))
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan and "InMemoryFileIndex(1 paths)" in plan


def test_a_copy_shuffles_nothing(spark, source):
    copied = read_table(spark, source)
    assert "Exchange" not in plan_of(copied)


def test_partitions_come_and_go(spark, given, lake, source):
    target = lake.table("lines", catalog=lake.target)
    copy_table(spark, source, target)
    replace_table(given("orders"), target)
    assert partition_columns(spark, target) == ()
    assert read_table(spark, target).count() == 1500
    copy_table(spark, source, target)
    assert partition_columns(spark, target) == ("l_returnflag",)
    assert check_contents(spark, source, target).rows == 6000


def test_null_and_odd_partition_values(spark, lake):
    source, target = lake.table("odd"), lake.table("odd", catalog=lake.target)
    values = spark.createDataFrame(
        [(1, None, None), (2, "a b/c=%", 1.5), (3, "ß", None)], "id INT, part STRING, more DOUBLE"
    )
    replace_table(values, source, partition_by=["part", "more"])
    copy_table(spark, source, target, check=CONTENT)
    assert rows(read_table(spark, target).select("id", "part", "more")) == rows(values)


def test_an_empty_text_is_no_partition(spark, lake):
    values = spark.createDataFrame([(1, ""), (2, "x")], "id INT, part STRING")
    with pytest.raises(ValueError, match="1 rows have an empty text in partition column part"):
        replace_table(values, lake.table("blank"), partition_by=["part"])


def test_an_empty_partitioned_table(spark, lake, source):
    empty, target = lake.table("none"), lake.table("none", catalog=lake.target)
    replace_table(read_table(spark, source).limit(0), empty, partition_by=["l_returnflag"])
    assert copy_table(spark, empty, target, check=CONTENT) == (0, 0, None)
    assert partition_columns(spark, target) == ("l_returnflag",)


def test_a_failed_declaration_brings_the_partitioned_table_back(spark, lake, source, monkeypatch):
    target = lake.table("lines", catalog=lake.target)
    copy_table(spark, source, target)
    real = "lakehaul.sinks.tables._declare"
    monkeypatch.setattr(real, lambda *_: (_ for _ in ()).throw(RuntimeError("no declaration")))
    with pytest.raises(RuntimeError, match="no declaration"):
        copy_table(spark, source, target)
    assert partition_columns(spark, target) == ("l_returnflag",)
    assert check_contents(spark, source, target).rows == 6000


def test_a_managed_partitioned_table_keeps_its_files_when_it_is_replaced(spark, lake, monkeypatch):
    """Its partitions lie in folders that Spark deletes with a managed table."""
    table = lake.table("managed")
    create_table(spark, table, "id INT, a STRING, b DATE", partition_by=["a", "b"])
    values = spark.sql(
        "SELECT * FROM VALUES (1, 'x/y=%', DATE'2024-01-01'), (2, NULL, DATE'2024-01-02'), (3, 'z', NULL) AS t(id, a, b)"
    )
    append_table(values, table)
    before = rows(values)
    files = read_table(spark, table).inputFiles()
    assert len(files) == 3
    with monkeypatch.context() as patched:
        failing = lambda *_: (_ for _ in ()).throw(RuntimeError("no declaration"))
        patched.setattr("lakehaul.sinks.tables._declare", failing)
        with pytest.raises(RuntimeError, match="no declaration"):
            replace_table(values.limit(1), table, partition_by=["a", "b"])
    assert rows(read_table(spark, table)) == before
    replace_table(values.limit(1), table, partition_by=["a", "b"])
    assert read_table(spark, table).count() == 1
    # Files of the version before stay for those who read them.
    assert all(pathlib.Path(unquote(urlparse(f).path)).exists() for f in files)


def declared(spark, lake):
    table = lake.table("declared")
    create_table(
        spark,
        table,
        "id BIGINT NOT NULL COMMENT 'it''s the key', code CHAR(3), name VARCHAR(9) DEFAULT 'none',"
        " `odd name` STRUCT<`a b`: INT COMMENT 'inner', c: ARRAY<STRING>>, part DATE",
        partition_by=["part"],
    )
    set_table_properties(spark, table, {"owner.team": "a 'quoted' one"})
    append_table(
        spark.sql(
            "SELECT 1L AS id, 'abc' AS code, 'n' AS name,"
            " named_struct('a b', 1, 'c', array('x')) AS `odd name`, DATE'2024-01-01' AS part"
        ),
        table,
    )
    return table


def test_a_copy_is_described_alike(spark, lake):
    source, target = declared(spark, lake), lake.table("declared", catalog=lake.target)
    copy_table(spark, source, target, check=CONTENT)
    assert table_shape(spark, target).declares() == table_shape(spark, source).declares()
    by_name = {r.column_name: r for r in described(spark, target).collect()}
    assert by_name["id"].comment == "it's the key"
    assert (by_name["code"].data_type, by_name["name"].data_type) == ("char(3)", "varchar(9)")
    assert by_name["name"].default_value == "'none'" and by_name["part"].is_partition
    assert table_shape(spark, target).properties == {"owner.team": "a 'quoted' one"}


def test_a_changed_comment_reaches_the_copy(spark, lake):
    source, target = lake.table("plain"), lake.table("plain", catalog=lake.target)
    create_table(spark, source, "id INT COMMENT 'old'")
    copy_table(spark, source, target)
    from lakehaul.names import table_name

    spark.sql(f"ALTER TABLE {table_name(spark, source)} ALTER COLUMN id COMMENT 'new'")
    copy_table(spark, source, target)
    assert [r.comment for r in described(spark, target).collect()] == ["new"]


def test_an_empty_clone_declares_all(spark, lake):
    source, target = declared(spark, lake), lake.table("cloned", catalog=lake.target)
    appended = append_copy(spark, source, target)
    assert (appended.source_count, appended.target_count) == (1, 1)
    assert table_shape(spark, target).declares() == table_shape(spark, source).declares()


def test_rows_alone_leave_comments_as_they_are(spark, lake):
    table = lake.table("kept")
    create_table(spark, table, "id INT COMMENT 'stays'")
    replace_table(spark.sql("SELECT 1 AS id"), table)
    assert [r.comment for r in described(spark, table).collect()] == ["stays"]


def files_of(frame) -> int:
    return len(frame.inputFiles())


def test_many_small_files_become_few(spark, given, lake, tmp_path):
    given("lineitem").repartition(60).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert write_folder(small, str(tmp_path / "sized"), file_bytes=256 << 10) == 6000
    sized = spark.read.parquet(str(tmp_path / "sized"))
    assert files_of(small) == 60 and 1 <= files_of(sized) <= 6
    assert rows(sized) == rows(small)


def test_partitions_of_a_copy_are_put_together(spark, given, lake):
    source, target = lake.table("lines"), lake.table("lines", catalog=lake.target)
    replace_table(given("lineitem").repartition(20), source, partition_by=["l_returnflag"])
    assert files_of(read_table(spark, source)) == 60
    assert copy_table(spark, source, target, check=CONTENT, file_bytes=64 << 20).succeeded
    assert files_of(read_table(spark, target)) == 3


def test_a_table_of_unknown_size_needs_a_number(spark, lake, source):
    with pytest.raises(ValueError, match="input_bytes"):
        replace_table(read_table(spark, source), lake.table("x"), file_bytes=1 << 20)


def test_rows_of_a_frame_can_be_partitioned_and_sized(spark, given, lake):
    table = lake.table("sized")
    replace_table(given("orders").repartition(9), table, partition_by=["o_orderstatus"], file_bytes=1 << 30)
    kinds = given("orders").select("o_orderstatus").distinct().count()
    assert files_of(read_table(spark, table)) == kinds
    assert read_table(spark, table).agg(F.sum("o_orderkey")).collect() == given("orders").agg(F.sum("o_orderkey")).collect()
