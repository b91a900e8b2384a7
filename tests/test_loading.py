from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakehaul.catalog import list_tables
from lakehaul.operators.columns import empty_like
from lakehaul.plans import csv_to_parquet, csv_to_table
from lakehaul.sinks import write_folder
from lakehaul.sources import literal_rows, read_csv, read_folder, read_table, read_view
from tests.conftest import CHANGES

AT = datetime(2024, 1, 1)


def as_csv(df, path) -> str:
    df.write.option("header", True).csv(str(path))
    return str(path)


def test_types_are_inferred_or_given(spark, given, tmp_path):
    path = as_csv(given("orders"), tmp_path / "csv")
    inferred = read_csv(spark, path)
    assert inferred.schema["o_orderkey"].dataType.simpleString() == "int"
    assert inferred.schema["o_orderdate"].dataType.simpleString() == "timestamp"
    declared = read_csv(spark, path, given("orders").schema)
    assert declared.schema == given("orders").schema
    assert declared.exceptAll(given("orders")).isEmpty()


def test_one_odd_value_makes_an_inferred_column_text(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("n,d\n1,2024-01-01\n2,x\n")
    (tmp_path / "csv" / "b.csv").write_text("n,d\nmany,2024-01-02\n")
    inferred = read_csv(spark, str(tmp_path / "csv"))
    assert inferred.schema.simpleString() == "struct<n:string,d:string>"
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, str(tmp_path / "csv"), "n INT, d STRING").collect()
    declared = read_csv(spark, str(tmp_path / "csv"), "n INT, d STRING", mode="PERMISSIVE")
    assert sorted(row.n or 0 for row in declared.collect()) == [0, 1, 2]


def test_header_must_name_the_given_columns(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("n,d\n1,x\n")
    (tmp_path / "csv" / "b.csv").write_text("d,n\n5,2\n")
    folder, columns = str(tmp_path / "csv"), "n STRING, d STRING"
    with pytest.raises(Exception, match="header"):
        read_csv(spark, folder, columns).collect()
    assert read_csv(spark, folder, columns, enforceSchema=True).count() == 2


def test_text_with_line_breaks(spark, given, tmp_path):
    documents = given("documents")
    assert not documents.where("text LIKE '%\\n%'").isEmpty()
    whole = {"multiLine": True, "escape": '"', "lineSep": "\n"}
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    write = documents.write.option("header", True).options(escape='"', **spaces)
    write.csv(str(tmp_path / "csv"))
    read = read_csv(spark, str(tmp_path / "csv"), documents.schema, **whole, **spaces)
    assert read.count() == documents.count()
    assert read.exceptAll(documents).isEmpty()


def test_csv_to_parquet(spark, given, tmp_path):
    loaded = csv_to_parquet(
        spark, as_csv(given("lineitem"), tmp_path / "csv"), str(tmp_path / "out"), AT
    )
    assert loaded.rows == given("lineitem").count() == loaded.data.count()
    assert loaded.data.schema.names == [*given("lineitem").columns, "current_date"]
    assert [row[0] for row in loaded.data.select("current_date").distinct().collect()] == [AT]


def test_output_that_exists_is_refused_and_kept(spark, given, tmp_path):
    out = str(tmp_path / "out")
    write_folder(given("nation"), out)
    with pytest.raises(FileExistsError):
        csv_to_parquet(spark, as_csv(given("orders"), tmp_path / "csv"), out)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        write_folder(given("region"), out)
    assert read_folder(spark, out).count() == 25


def test_failed_load_can_be_tried_again(spark, given, tmp_path):
    out = str(tmp_path / "out")
    wrong = given("orders").withColumn("o_custkey", F.raise_error(F.lit("cannot read")))
    with pytest.raises(Exception, match="cannot read"):
        write_folder(wrong, out)
    assert write_folder(given("orders"), out) == 1500


def test_csv_to_table(spark, given, lake, tmp_path):
    target, out = lake.table("trips"), str(tmp_path / "out")
    csv_to_table(
        spark, as_csv(given("orders"), tmp_path / "csv"), out, target, "trips_view", load_time=AT
    )
    assert read_table(spark, target).count() == 1500
    assert read_view(spark, "trips_view").count() == 1500
    assert read_folder(spark, out).count() == 1500
    spark.catalog.dropTempView("trips_view")
    assert [listed.table for listed in list_tables(spark, "db", lake.source)] == ["trips"]


def test_empty_input_makes_an_empty_output(spark, given, tmp_path):
    out = str(tmp_path / "out")
    assert write_folder(empty_like(given("orders")), out) == 0
    assert read_folder(spark, out).schema == given("orders").schema


def test_literal_rows(spark):
    named = literal_rows(spark, CHANGES, ["id", "creation_date", "last_update_time"])
    assert [tuple(row) for row in named.collect()] == CHANGES
    assert named.schema.simpleString().count("string") == 3
