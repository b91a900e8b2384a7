"""Rows that do not fit a CSV schema: kept aside, with file and reason."""

import pytest

from lakehaul.plans import csv_to_parquet, csv_to_table
from lakehaul.sources import read_csv_marked, read_table

SCHEMA = "id INT, name STRING, price DOUBLE, at DATE"
FIRST = 'id,name,price,at\n1,"a, b",1.5,2024-01-01\nx,c,2.5,2024-01-02\n3,d,oops,never\n'
SECOND = "id,name,price,at\n4,e,4.5,2024-01-04\n5,f\n6,g,6.5,2024-01-06,extra\n,,,\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first.csv").write_text(FIRST)
    (tmp_path / "in" / "second.csv").write_text(SECOND)
    return str(tmp_path / "in")


def told(frame):
    return sorted((r.bad_file.rpartition("/")[2], r.bad_record, r.bad_reason) for r in frame.collect())


BAD = [
    ("first.csv", "3,d,oops,never", "price: 'oops' is no double; at: 'never' is no date"),
    ("first.csv", "x,c,2.5,2024-01-02", "id: 'x' is no int"),
    ("second.csv", "5,f", "not 4 fields"),
    ("second.csv", "6,g,6.5,2024-01-06,extra", "not 4 fields"),
]


def test_good_and_bad_rows_are_all_rows(spark, folder, tmp_path):
    loaded = csv_to_parquet(spark, folder, str(tmp_path / "out"), schema=SCHEMA, quarantine=True)
    assert (loaded.rows, loaded.bad_rows) == (3, 4)
    assert loaded.data.columns == ["id", "name", "price", "at", "current_date"]
    assert {(r.id, r.name) for r in loaded.data.collect()} == {(1, "a, b"), (4, "e"), (None, None)}
    assert told(loaded.quarantined) == BAD


def test_a_folder_without_bad_rows_and_one_without_good_ones(spark, tmp_path):
    for name, text, counts in (("good", "id\n1\n2\n", (2, 0)), ("bad", "id\nx\ny\n", (0, 2))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(text)
        loaded = csv_to_parquet(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), schema="id INT", quarantine=True)
        assert (loaded.rows, loaded.bad_rows) == counts
        assert (loaded.data.count(), loaded.quarantined.count()) == counts


def test_options_of_the_reader_hold_for_the_reason_too(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id|price\n1|2,5\n2|'3|4'\n")
    marked = read_csv_marked(spark, str(tmp_path / "in"), "id INT, price DOUBLE", sep="|", quote="'")
    assert [(r.bad_record, r.bad_reason) for r in marked.collect()] == [
        ("1|2,5", "price: '2,5' is no double"),
        ("2|'3|4'", "price: '3|4' is no double"),
    ]


def test_the_table_holds_the_rows_that_fit(spark, folder, lake):
    target = lake.table("trips")
    loaded = csv_to_table(
        spark, folder, f"{lake.folder}/out", target, schema=SCHEMA, quarantine=True
    )
    assert read_table(spark, target).count() == loaded.rows == 3
    assert read_table(spark, target).columns == loaded.data.columns


def test_a_quarantine_needs_a_schema_and_free_names(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="needs a schema"):
        csv_to_parquet(spark, folder, str(tmp_path / "out"), quarantine=True)
    with pytest.raises(ValueError, match="bad_file"):
        read_csv_marked(spark, folder, "id INT, bad_file STRING")
