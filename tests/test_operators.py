import time
from datetime import datetime

import pytest
from hypothesis import HealthCheck, settings
from hypothesis import given as given_rows
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakehaul.functions import insert_time
from lakehaul.operators import (
    CountedWrite,
    CountLost,
    empty_like,
    first_rows,
    optional,
    precombine,
    require_columns,
    require_record_keys,
    row_count,
    schema_rows,
    with_load_time,
)
from tests.conftest import CHANGES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_load_time_is_one_constant(given):
    at = datetime(2024, 5, 6, 7, 8, 9)
    stamped = with_load_time(given("nation"), at)
    assert [row[0] for row in stamped.select("current_date").distinct().collect()] == [at]
    assert with_load_time(given("nation")).select("current_date").distinct().count() == 1


def test_insert_time_is_the_same_for_all_rows(spark):
    assert spark.range(1000).select(insert_time().alias("ts")).distinct().count() == 1


def test_empty_like_keeps_the_schema_and_reads_nothing(given):
    empty = empty_like(given("embeddings"))
    assert empty.schema == given("embeddings").schema
    assert empty.count() == 0
    assert "LocalTableScan <empty>" in plan_of(empty)


def test_schema_rows(given):
    rows = [(row.column_name, row.data_type) for row in schema_rows(given("region")).collect()]
    assert rows == [("r_regionkey", "int"), ("r_name", "string")]


def test_row_count_reads_no_column(given):
    counted = row_count(given("lineitem"))
    assert counted.collect() == [(given("lineitem").count(),)]
    assert "ReadSchema: struct<>" in plan_of(counted)


def test_first_rows(given):
    assert first_rows(given("orders"), 5).count() == 5
    assert first_rows(given("customer")).count() == 20
    keys = [row.o_orderkey for row in first_rows(given("orders"), 3, ["o_orderkey"]).collect()]
    assert keys == sorted(row.o_orderkey for row in given("orders").collect())[:3]


def test_counted_write_counts_in_the_same_pass(given, tmp_path):
    counted = CountedWrite(given("orders"))
    counted.rows.write.parquet(str(tmp_path / "out"))
    assert counted.count() == 1500


def test_a_lost_count_is_an_error(given):
    counted = CountedWrite(given("orders"), patience=0.1)
    started = time.monotonic()
    with pytest.raises(CountLost):
        counted.count()
    assert time.monotonic() - started < 30


def test_precombine_keeps_the_latest_change(changes):
    kept = precombine(changes, ["id"], "last_update_time")
    assert sorted(tuple(row) for row in kept.collect()) == sorted(
        [CHANGES[0], CHANGES[2], CHANGES[3]]
    )


def test_precombine_with_a_hot_key_against_brute_force(spark, given):
    # Every third row belongs to one key, with ties in the ordering column.
    lines = given("lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(F.col("l_partkey")).alias("key"),
        F.col("l_quantity").alias("at"),
        "l_orderkey",
        "l_linenumber",
    )
    best = {}
    for row in lines.collect():
        rank = (row.at, row.l_orderkey, row.l_linenumber)
        best[row.key] = max(best.get(row.key, rank), rank)
    wanted = {(key, *rank) for key, rank in best.items()}
    named = precombine(lines.repartition(7), ["key"], "at", ["l_orderkey", "l_linenumber"])
    unnamed = precombine(lines.repartition(3), ["key"], "at")
    assert {tuple(row) for row in named.collect()} == wanted
    assert {tuple(row) for row in unnamed.collect()} == wanted


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given_rows(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(0, 3)),
            st.one_of(st.none(), st.integers(0, 2)),
            st.text("ab", max_size=2),
        ),
        min_size=1,
        max_size=40,
    ),
    st.integers(1, 5),
)
def test_precombine_of_any_rows(spark, rows, partitions):
    frame = spark.createDataFrame(rows, "key int, at int, name string").repartition(partitions)
    best = {}
    for key, at, name in rows:
        rank = (at is not None, at or 0, name)
        best[key] = max(best.get(key, rank), rank)
    kept = {row.key: (row.at is not None, row.at or 0, row.name) for row in named(frame)}
    assert kept == best


def named(frame):
    kept = precombine(frame, ["key"], "at").collect()
    assert len({row.key for row in kept}) == len(kept)
    return kept


def test_precombine_ranks_before_the_shuffle(given):
    plan = plan_of(precombine(given("events"), ["user_id"], "ts", ["event_id"]))
    final, partial = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in final and ", Final" in final
    assert "WindowGroupLimit" in partial and ", Partial" in partial
    assert "Exchange" not in partial


def test_precombine_ranks_nulls_last_and_skips_maps(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, CAST(NULL AS INT), map('a', 1)), (1, 5, map('b', 2))"
        " AS v(k, o, m)"
    )
    [kept] = precombine(rows, ["k"], "o").collect()
    assert (kept.o, kept.m) == (5, {"b": 2})


def test_columns_are_checked_before_any_work(given):
    assert require_columns(given("nation"), ["N_NATIONKEY"]) == ["n_nationkey"]
    with pytest.raises(ValueError, match="checksum"):
        precombine(given("nation"), ["n_nationkey", "checksum"], "n_name")


def test_rows_without_any_key_fail_the_job(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, NULL), (NULL, 'a'), (2, 'b') AS v(k, l)")
    assert require_record_keys(rows, ["k", "l"]).count() == 3
    with pytest.raises(Exception, match="without a record key"):
        require_record_keys(rows, ["k"]).collect()


def test_optional_allows_nulls_at_every_level(spark):
    strict = spark.sql("SELECT 1 AS a, array(named_struct('b', 2)) AS c, map('k', 3) AS d").schema
    assert "NOT NULL" in strict.toDDL()
    loose = optional(strict)
    assert "NOT NULL" not in loose.toDDL()
    assert loose.simpleString() == strict.simpleString()
