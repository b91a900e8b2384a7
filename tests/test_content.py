"""Fingerprints, canonical forms and what they settle."""

import itertools

import pytest
from pyspark.sql import functions as F

from lakehaul.operators import (
    ContentMismatch,
    check_contents,
    compare_contents,
    fingerprint,
    precombine,
)
from lakehaul.plans import copy_table
from lakehaul.sinks import CONTENT, create_table, replace_table
from lakehaul.sources import read_table

ROWS = """
    SELECT * FROM VALUES
        (1, map('a', 1.5D, 'b', CAST(NULL AS DOUBLE)), array(1, NULL), named_struct('x', 1, 'y', NULL)),
        (2, map('c', 0.0D), array(NULL, 1), named_struct('x', NULL, 'y', 'z')),
        (3, NULL, NULL, NULL), (3, NULL, NULL, NULL)
    AS t(id, m, a, s)"""


def test_order_and_partitions_do_not_matter(spark):
    rows = spark.sql(ROWS)
    turned = rows.orderBy(F.desc("id")).repartition(5).withColumn(
        "m", F.map_from_entries(F.reverse(F.map_entries("m")))
    )
    assert fingerprint(rows) == fingerprint(turned.select(rows.columns))
    assert fingerprint(rows).nulls == {"id": 0, "m": 2, "a": 2, "s": 2}


@pytest.mark.parametrize(
    "change",
    [
        "if(id = 2, map('c', 0.5D), m) AS m, a, s",
        "if(id = 1, map('a', CAST(NULL AS DOUBLE), 'b', 1.5D), m) AS m, a, s",
        "m, if(id = 1, array(NULL, 1), a) AS a, s",
        "m, a, if(id = 2, named_struct('x', 1, 'y', CAST(NULL AS STRING)), s) AS s",
    ],
)
def test_one_changed_value_is_seen(spark, change):
    rows = spark.sql(ROWS)
    changed = rows.selectExpr("id", *[part.strip() for part in _split(change)])
    assert fingerprint(rows) != fingerprint(changed, rows.schema)


def _split(text):
    """Commas outside of brackets."""
    depth, part, out = 0, "", []
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def test_values_swapped_between_rows_are_seen(spark):
    rows = spark.sql("SELECT id, id * 2 AS v FROM range(10)")
    swapped = rows.withColumn("v", F.when(F.col("id") == 1, 4).when(F.col("id") == 2, 2).otherwise(F.col("v")))
    found = fingerprint(rows).differences(fingerprint(swapped, rows.schema))
    assert found == ["values differ"]


def test_zeros_and_nans_are_one_value_each(spark):
    left = spark.sql("SELECT 0.0D AS d, double('nan') AS n, float('-0.0') AS f")
    right = spark.sql("SELECT double('-0.0') AS d, double('nan') AS n, 0.0F AS f")
    assert fingerprint(left) == fingerprint(right)


def test_empty_tables_share_a_fingerprint(spark):
    rows = spark.sql(ROWS)
    assert fingerprint(rows.limit(0)) == fingerprint(rows.where("id > 9"))


def test_check_and_compare_by_name(spark, given, lake):
    source, target = lake.table("orders"), lake.table("orders", catalog=lake.target)
    replace_table(given("orders"), source)
    replace_table(given("orders").select(*reversed(given("orders").columns)), target)
    assert check_contents(spark, source, target).rows == 1500
    changed = given("orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") != 1, F.col("o_totalprice"))
    )
    replace_table(changed, target)
    with pytest.raises(ContentMismatch, match="o_totalprice: 0 nulls, "):
        check_contents(spark, source, target)
    by_column = {r.column_name: r for r in compare_contents(spark, source, target).collect()}
    assert by_column["o_custkey"].source_nulls == by_column["o_custkey"].target_nulls == 0
    assert not by_column["o_custkey"].same_rows
    replace_table(given("orders").drop("o_custkey"), target)
    with pytest.raises(ContentMismatch, match="columns"):
        check_contents(spark, source, target)


def test_a_copy_whose_content_changes_is_refused(spark, lake, monkeypatch):
    """Files that give other rows than were written keep the old table in place."""
    source, target = lake.table("t"), lake.table("t", catalog=lake.target)
    replace_table(spark.range(10).selectExpr("id", "id * 1.5D AS v"), source)
    assert copy_table(spark, source, target, check=CONTENT) == (10, 10, None)
    real = fingerprint

    def other(df, schema=None):
        return real(df.withColumn("v", F.when(F.col("id") == 3, 7.0).otherwise(F.col("v"))), schema)

    monkeypatch.setattr("lakehaul.sinks.tables.fingerprint", other)
    before = read_table(spark, target).inputFiles()
    with pytest.raises(ContentMismatch, match="values differ"):
        copy_table(spark, source, target, check=CONTENT)
    assert read_table(spark, target).inputFiles() == before


def test_every_type_a_table_can_hold_is_compared(spark, lake):
    source, target = lake.table("wide"), lake.table("wide", catalog=lake.target)
    create_table(
        spark,
        source,
        "a BOOLEAN, b TINYINT, c DECIMAL(20, 3), d BINARY, e DATE, f TIMESTAMP, g TIMESTAMP_NTZ,"
        " h VARCHAR(9), i MAP<STRING, ARRAY<MAP<INT, DOUBLE>>>, j STRUCT<x: MAP<INT, STRING>>,"
        " k INTERVAL DAY TO SECOND, l VARIANT",
    )
    name = str(source).split(".")
    spark.sql(
        f"INSERT INTO `{name[0]}__{name[1]}`.`{name[2]}` SELECT true, 1, 2.5, x'00ff', DATE'2024-01-01',"
        " TIMESTAMP'2024-01-01 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'h',"
        " map('k', array(map(1, 0.5D, 2, NULL))), named_struct('x', map(1, 'y')),"
        " INTERVAL '1 00:00:00' DAY TO SECOND, parse_json('{\"a\": [1, null]}')"
    )
    assert copy_table(spark, source, target, check=CONTENT) == (1, 1, None)
    assert check_contents(spark, source, target).rows == 1


def test_precombine_settles_by_any_type(spark):
    base = spark.sql("""
        SELECT 1 AS k, 1 AS at, n, m, v, i FROM VALUES
            (1, map('a', 1, 'b', 2), parse_json('{"x": 1}'), make_interval(0, 1)),
            (2, map('b', 2, 'a', 1), parse_json('{"x": 2}'), make_interval(0, 1)),
            (3, map('a', 1, 'c', 0), parse_json('{"x": 1}'), make_interval(0, 1)),
            (4, map('c', 0, 'a', 1), parse_json('{"x": 1}'), make_interval(0, 0, 0, 45)),
            (5, map('c', 0, 'a', 1), parse_json('{"x": 1}'), make_interval(0, 0, 0, 45, 1, 2, 3.5))
        AS t(n, m, v, i)""")  # fmt: skip
    found = set()
    for order in itertools.islice(itertools.permutations(range(1, 6)), 0, 120, 17):
        at = F.array_position(F.array(*map(F.lit, order)), F.col("n"))
        mixed = base.orderBy(at).drop("n").coalesce(1)
        [kept] = precombine(mixed, ["k"], "at").selectExpr("sort_array(map_entries(m)) m", "to_json(v) v", "string(i) i").collect()
        found.add(str(kept))
    assert len(found) == 1
    assert "1 months" in found.pop()
