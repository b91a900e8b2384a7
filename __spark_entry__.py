"""

Every query reads the whole of the given tables.  Queries that write do so in a
fresh folder, in databases and catalogs whose names no other call uses, and leave
the files for whoever reads the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehaul.catalog import (
    create_database,
    describe_table,
    described,
    drop_tables,
    list_tables,
    partition_columns,
    set_current_database,
    set_table_properties,
    table_properties,
)
from lakehaul.functions import insert_time
from lakehaul.names import PREFIXES, TableRef
from lakehaul.operators import (
    check_counts,
    compare_contents,
    first_rows,
    precombine,
    row_count,
    row_count_sql,
    schema_rows,
    with_load_time,
)
from lakehaul.plans import (
    append_copy,
    catalog_inventory,
    copy_table,
    create_append_read,
    create_insert_read,
    csv_to_parquet,
    csv_to_table,
    keyed_load,
    migrate_database,
    migrate_databases,
)
from lakehaul.plans.ledger import Ledger
from lakehaul.sinks import (
    CONTENT,
    append_table,
    clone_empty,
    create_table,
    keyed_replace,
    register_folder,
    replace_table,
    write_folder,
)
from lakehaul.sources import (
    literal_rows,
    read_csv,
    read_folder,
    read_sql,
    read_table,
    read_view,
)
from lakehaul.storage import fresh_folder

SMALLEST = "/root/testdata/sf0.001"
LOAD_TIME = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT_KEYS = ["user_id", "event_type"]
# Three change rows, one id twice.
CHANGE_ROWS = [
    ("pump-a", "2023-03-01", "2023-03-09T06:00:00.5Z"),
    ("pump-a", "2023-03-01", "2023-03-08T23:30:00.25Z"),
    ("pump-b", "2023-03-02", "2023-03-10T00:00:01Z"),
]
CHANGE_COLUMNS = "id string, creation_date string, last_update_time string"


class Scratch:
    """A fresh folder, and databases in it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set(PREFIXES, "true")  # several catalogs in the only one there is
        self.folder = fresh_folder(spark)
        self.databases: dict[tuple[str | None, str], None] = {}
        self.suffix = uuid.uuid4().hex[:12]

    def given(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def catalog(self, name: str) -> str:
        return f"{name}_{self.suffix}"

    def table(self, table: str, database: str = "work", catalog: str = "lake") -> TableRef:
        """A table name in a database of this scratch, which is created if missing."""
        return TableRef(self.database(database, catalog), table, self.catalog(catalog))

    def database(self, database: str, catalog: str = "lake") -> str:
        if (catalog, database) not in self.databases:
            location = f"{self.folder}/{catalog}/{database}"
            create_database(self.spark, database, self.catalog(catalog), location)
            self.databases[catalog, database] = None
        return database

    def register(self, table: str, database: str = "work", catalog: str = "lake") -> TableRef:
        """A given table under a name, read where it lies."""
        ref = self.table(table, database, catalog)
        schema = self.given(table).schema
        register_folder(self.spark, ref, f"{self.sf_dir}/{table}.parquet", schema)
        return ref

    def unreadable(self, table: str, database: str, catalog: str = "lake") -> TableRef:
        """A table whose files are not what the catalog says."""
        ref = self.table(table, database, catalog)
        path = f"{self.folder}/{table}"
        given = self.given(table)
        given.write.csv(path)
        register_folder(self.spark, ref, path, given.schema)
        return ref

    def csv(self, table: str) -> str:
        path = f"{self.folder}/{table}_csv"
        self.given(table).write.option("header", True).csv(path)
        return path


def cast_like(df: DataFrame, given: DataFrame) -> DataFrame:
    """Columns of ``given`` in its types; CSV inference narrows some."""
    return df.select(*[F.col(field.name).cast(field.dataType) for field in given.schema])


def stamped_like(df: DataFrame, given: DataFrame) -> DataFrame:
    """The same plus the load time in UTC, without a zone as in the given tables."""
    casts = [F.col(field.name).cast(field.dataType) for field in given.schema]
    local = F.col("current_date").cast("timestamp_ntz")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return df.select(*casts, utc.alias("current_date"))


# --- loading ------------------------------------------------------------------


def csv_scan_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    return cast_like(read_csv(spark, scratch.csv("orders")), scratch.given("orders"))


def csv_scan_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    return read_csv(spark, scratch.csv("lineitem"), scratch.given("lineitem").schema)


def load_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = Scratch(spark, sf_dir).given("lineitem")
    return stamped_like(with_load_time(given, LOAD_TIME), given)


def folder_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    documents = scratch.given("documents")
    path = f"{scratch.folder}/documents"
    write_folder(documents, path)
    return read_folder(spark, path, documents.schema)


def csv_to_parquet_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    path = f"{scratch.folder}/orders"
    loaded = csv_to_parquet(spark, scratch.csv("orders"), path, LOAD_TIME)
    return stamped_like(loaded.data, scratch.given("orders"))


def etl_registered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("trips")
    path = f"{scratch.folder}/orders"
    csv_to_table(spark, scratch.csv("orders"), path, target, load_time=LOAD_TIME)
    return stamped_like(read_table(spark, target), scratch.given("orders"))


def temp_view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    view = f"trips_{scratch.suffix}"
    given = scratch.given("lineitem")
    csv_to_table(
        spark,
        scratch.csv("lineitem"),
        f"{scratch.folder}/lineitem",
        scratch.table("trips"),
        view=view,
        load_time=LOAD_TIME,
        schema=given.schema,
    )
    rows = stamped_like(read_view(spark, view), given)
    spark.catalog.dropTempView(view)
    return rows


def _orders_with_bad_customers(scratch: Scratch) -> str:
    """Orders as CSV; the customer of every seventh is no number."""
    path = f"{scratch.folder}/orders_csv"
    customer = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("c"), F.col("o_custkey")))
    orders = scratch.given("orders")
    spoiled = orders.withColumn("o_custkey", F.coalesce(customer, F.col("o_custkey").cast("string")))
    spoiled.write.option("header", True).csv(path)
    return path


def csv_quarantine_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered load whose bad rows are set aside; the rows that fit."""
    scratch = Scratch(spark, sf_dir)
    given, target = scratch.given("orders"), scratch.table("orders")
    csv_to_table(
        spark,
        _orders_with_bad_customers(scratch),
        f"{scratch.folder}/orders",
        target,
        schema=given.schema,
        load_time=LOAD_TIME,
        quarantine=True,
    )
    return stamped_like(read_table(spark, target), given)


def csv_quarantine_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows set aside, with the counts of both kinds."""
    scratch = Scratch(spark, sf_dir)
    path, schema = _orders_with_bad_customers(scratch), scratch.given("orders").schema
    loaded = csv_to_parquet(spark, path, f"{scratch.folder}/orders", schema=schema, quarantine=True)
    return loaded.quarantined.select(
        F.split("bad_record", ",")[0].cast("bigint").alias("o_orderkey"),
        "bad_reason",
        F.col("bad_file").endswith(".csv").alias("from_file"),
        F.lit(loaded.rows).cast("bigint").alias("good_rows"),
        F.lit(loaded.bad_rows).cast("bigint").alias("bad_rows"),
    )


# --- tables -------------------------------------------------------------------


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, Scratch(spark, sf_dir).register("events"))


def sql_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_sql(spark, Scratch(spark, sf_dir).register("lineitem"))


def current_database_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table found by its bare name in the current database."""
    scratch = Scratch(spark, sf_dir)
    scratch.register("conversations")
    before = spark.catalog.currentDatabase()
    set_current_database(spark, "work", scratch.catalog("lake"))
    try:
        return spark.table("conversations")
    finally:
        spark.catalog.setCurrentDatabase(before)


def create_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    return create_append_read(scratch.given("customer"), scratch.table("customer")).data


def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    part, target = scratch.given("part"), scratch.table("part")
    create_append_read(part, target)
    return create_append_read(part, target).data


def literal_rows_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal rows next to the orders as change rows."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("changes")
    create_append_read(literal_rows(spark, CHANGE_ROWS, CHANGE_COLUMNS), target, CHANGE_COLUMNS)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = scratch.given("orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        day.alias("creation_date"),
        day.alias("last_update_time"),
    )
    return create_append_read(orders, target).data


def insert_values_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two literal rows, then the customers with the time of their insert."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("inserted")
    create_insert_read(
        spark,
        target,
        "id BIGINT, data STRING, ts TIMESTAMP",
        "(:first, 'first row', current_timestamp()), (:second, 'second row', current_timestamp())",
        {"first": -1, "second": -2},
    )
    customers = scratch.given("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("data"), insert_time().alias("ts")
    )
    append_table(customers, target)
    return read_sql(spark, target).select("id", "data")


def current_timestamp_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("stamped")
    stamped = scratch.given("orders").select("o_orderkey", insert_time().alias("ts"))
    written = create_append_read(stamped, target, "o_orderkey BIGINT, ts TIMESTAMP").data
    return written.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ts").alias("n_times")
    )


def empty_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the clone, its row count, and its row count once filled."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.register("part"), scratch.table("part_clone")
    clone_empty(spark, source, target)
    before = read_table(spark, target).count()
    after = append_table(read_table(spark, source), target)
    return schema_rows(read_table(spark, target)).select(
        "column_name",
        "data_type",
        F.lit(before).cast("bigint").alias("rows_before"),
        F.lit(after).cast("bigint").alias("rows_after"),
    )


def empty_clone_at_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a clone before and after it is filled, read from its folder."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.register("customer"), scratch.table("customer_clone")
    path = f"{scratch.folder}/clone"
    clone_empty(spark, source, target, location=path)
    before = read_table(spark, target).count()
    append_table(read_table(spark, source), target)
    filled = read_folder(spark, path, read_table(spark, source).schema)
    return row_count(filled).select(
        F.lit(before).cast("bigint").alias("rows_before"), F.col("cnt").alias("rows_after")
    )


def create_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of customers replaced by suppliers: other rows, other columns."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("partners")
    replace_table(scratch.given("customer"), target)
    replace_table(scratch.given("supplier"), target)
    return read_table(spark, target)


def replace_from_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by twice its own rows."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("orders")
    replace_table(scratch.given("orders"), target)
    rows = read_table(spark, target)
    replace_table(rows.unionAll(rows), target)
    return read_table(spark, target)


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    by_frame = row_count(scratch.given("lineitem")).select(F.lit("frame").alias("api"), "cnt")
    by_sql = row_count_sql(spark, scratch.register("lineitem"))
    return by_frame.unionAll(by_sql.select(F.lit("sql").alias("api"), "cnt"))


def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(Scratch(spark, sf_dir).given("orders"), 5, ["o_orderkey"])


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names and types of a table, with its row count."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("orders")
    rows = create_append_read(scratch.given("orders"), target).rows
    details = describe_table(spark, target).select("col_name", "data_type")
    return details.where(F.col("col_name").startswith("o_")).withColumn(
        "n_rows", F.lit(rows).cast("bigint")
    )


def drop_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in a database after two of its tables are dropped."""
    scratch = Scratch(spark, sf_dir)
    for table in ("customer", "part", "supplier"):
        replace_table(scratch.given(table), scratch.table(table))
    missing = scratch.table("never_there")
    drop_tables(spark, [scratch.table("customer"), scratch.table("part"), missing])
    left = [
        row_count(read_table(spark, scratch.table(listed.table))).select(
            F.lit(listed.table).alias("table"), "cnt"
        )
        for listed in list_tables(spark, "work", scratch.catalog("lake"))
        if not listed.is_temporary
    ]
    [only] = left
    return only


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties set on a filled table, with its row count."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("supplier")
    rows = create_append_read(scratch.given("supplier"), target).rows
    set_table_properties(
        spark,
        target,
        {
            "write.format.default": "parquet",
            "write.parquet.compression-codec": "snappy",
            "write.metadata.compression-codec": "gzip",
        },
    )
    own = table_properties(spark, target).where(F.col("key").startswith("write."))
    return own.withColumn("n_rows", F.lit(rows).cast("bigint"))


# --- keyed tables -------------------------------------------------------------


def precombine_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Scratch(spark, sf_dir).given("events")
    return precombine(events, EVENT_KEYS, "ts", ties=["event_id"])


def keyed_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a folder over earlier rows, registered, read by path."""
    scratch = Scratch(spark, sf_dir)
    events, target = scratch.given("events"), scratch.table("events_by_key")
    path = f"{scratch.folder}/events"
    keyed_load(events, path, ["user_id"], "ts", ["event_id"], target)
    return keyed_load(events, path, EVENT_KEYS, "ts", ["event_id"], target).data


def keyed_registered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read by the registered name."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("events_by_key")
    path = f"{scratch.folder}/events"
    keyed_load(scratch.given("events"), path, EVENT_KEYS, "ts", ["event_id"], target)
    return read_table(spark, target)


def keyed_replace_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest line per part and supplier, as a checked table replace."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("latest_lines")
    ties = ["l_orderkey", "l_linenumber"]
    lines = scratch.given("lineitem")
    keyed_replace(lines, target, ["l_partkey", "l_suppkey"], "l_shipdate", ties)
    return read_table(spark, target)


def keyed_published_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed load over an earlier one, published by the table's location alone."""
    scratch = Scratch(spark, sf_dir)
    events, target = scratch.given("events"), scratch.table("events_by_key")
    keyed_load(events, None, EVENT_KEYS, "event_id", register_as=target)
    return keyed_load(events, None, EVENT_KEYS, "ts", ["event_id"], target).data


def precombine_any_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and day that only a map tells apart."""
    by_day = Scratch(spark, sf_dir).given("events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        F.create_map(F.coalesce("event_type", F.lit("")), "value").alias("what"),
    )
    latest = precombine(by_day, ["user_id"], "day")
    return latest.select("user_id", "day", F.explode("what").alias("event_type", "value"))


# --- copies and migration -----------------------------------------------------

def copy_replace_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both sides of a copy that is run twice, and the copy's own count."""
    scratch = Scratch(spark, sf_dir)
    source = scratch.register("lineitem", catalog="source")
    target = scratch.table("lineitem")
    copy_table(spark, source, target)
    result = copy_table(spark, source, target)
    return row_count(read_table(spark, target)).select(
        F.lit(result.source_count).cast("bigint").alias("source_count"),
        F.lit(result.target_count).cast("bigint").alias("dest_count"),
        F.lit(result.succeeded).alias("succeeded"),
        F.col("cnt").alias("rows_found"),
    )


def copy_replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("orders")
    copy_table(spark, scratch.register("orders", catalog="source"), target)
    return read_table(spark, target)


def copy_nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array column copied, then taken apart."""
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("embeddings")
    copy_table(spark, scratch.register("embeddings", catalog="source"), target)
    return read_table(spark, target).select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "val")
    )


def copy_append_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("new_customer")
    append_copy(spark, scratch.register("customer", catalog="source"), target)
    return read_table(spark, target)


def copy_append_at_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into the same catalog, at a folder of its own, twice."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.register("part"), scratch.table("new_part")
    path = f"{scratch.folder}/elsewhere/new_part"
    append_copy(spark, source, target, location=path)
    append_copy(spark, source, target, location=path)
    return read_folder(spark, path, read_table(spark, source).schema)


def copy_replace_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    target = scratch.table("pages_renamed", "other")
    copy_table(spark, scratch.register("pages", catalog="source"), target)
    return read_table(spark, target)


def copy_partitioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table copied twice, its rows and the partition columns of the copy."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.table("lineitem", catalog="source"), scratch.table("lineitem")
    replace_table(scratch.given("lineitem"), source, partition_by=["l_returnflag", "l_linestatus"])
    for _ in range(2):
        copy_table(spark, source, target)
    columns = ",".join(partition_columns(spark, target))
    return read_table(spark, target).withColumn("partitioned_by", F.lit(columns))


def copy_sized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files put together by a copy, partition by partition."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.table("orders", catalog="source"), scratch.table("orders")
    orders = scratch.given("orders").repartition(40)
    replace_table(orders, source, partition_by=["o_orderstatus"])
    copy_table(spark, source, target, file_bytes=64 << 20)
    return read_table(spark, target)


def copy_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy declares: comments, defaults, text lengths and partitions, with its rows."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.table("customer", catalog="source"), scratch.table("customer")
    create_table(
        spark,
        source,
        "c_custkey BIGINT COMMENT 'the key', c_name VARCHAR(40), c_acctbal DOUBLE DEFAULT 0.5D,"
        " c_mktsegment STRING COMMENT 'of the market'",
        partition_by=["c_mktsegment"],
    )
    append_table(scratch.given("customer").drop("c_nationkey"), source)
    counts = copy_table(spark, source, target, check=CONTENT)
    return described(spark, target).withColumn("n_rows", F.lit(counts.target_count).cast("bigint"))


def content_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy, and one in which a single value differs, compared with their source."""
    scratch = Scratch(spark, sf_dir)
    source, given = scratch.register("documents", catalog="source"), scratch.given("documents")
    copy, changed = scratch.table("documents"), scratch.table("documents_changed")
    copy_table(spark, source, copy, check=CONTENT)
    first = given.agg(F.min("doc_id")).first()[0]
    one = F.when(F.col("doc_id") == first, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    replace_table(given.withColumn("n_chars", one), changed)
    cases = [
        compare_contents(spark, source, target).withColumn("copy", F.lit(name))
        for name, target in (("same", copy), ("changed", changed))
    ]
    return cases[0].unionAll(cases[1])


def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count two tables share."""
    scratch = Scratch(spark, sf_dir)
    source, target = scratch.register("documents"), scratch.table("documents_copy")
    replace_table(read_table(spark, source), target)
    shared = check_counts(spark, source, target)
    return row_count(read_table(spark, target)).withColumn(
        "shared", F.lit(shared).cast("bigint")
    )


def without_paths(report: DataFrame) -> DataFrame:
    """A failed copy's message names files; say only that it failed."""
    failed = F.col("succeeded") == F.lit(False)
    return report.withColumn("reason", F.when(failed, F.lit("failed")).otherwise(F.col("reason")))


def migrate_one_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, sf_dir)
    for table in ("customer", "lineitem", "nation", "orders", "supplier"):
        scratch.register(table, "sales", "source")
    scratch.database("sales", "target")
    return migrate_database(
        spark, "sales", scratch.catalog("source"), scratch.catalog("target"), parallelism=4
    )


def _two_databases(scratch: Scratch) -> None:
    for table in ("events", "orders"):
        scratch.register(table, "sales", "source")
    for table in ("documents", "embeddings"):
        scratch.register(table, "texts", "source")
    scratch.unreadable("conversations", "texts", "source")
    scratch.database("idle", "source")
    for database in ("sales", "texts", "idle"):
        scratch.database(database, "target")


def migrate_listed_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with blanks and a missing name; one table cannot be read."""
    scratch = Scratch(spark, sf_dir)
    _two_databases(scratch)
    source, target = scratch.catalog("source"), scratch.catalog("target")
    return without_paths(
        migrate_databases(spark, "texts , sales, missing", source, target).report
    )


def migrate_all_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every database, one of them empty."""
    scratch = Scratch(spark, sf_dir)
    _two_databases(scratch)
    source, target = scratch.catalog("source"), scratch.catalog("target")
    return without_paths(migrate_databases(spark, "*", source, target, parallelism=4).report)


def migration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables copied and failed per database, and the rows then found in its copies."""
    scratch = Scratch(spark, sf_dir)
    _two_databases(scratch)
    source, target = scratch.catalog("source"), scratch.catalog("target")
    summary = migrate_databases(spark, "*", source, target, parallelism=4).durations.drop("seconds")
    counted = catalog_inventory(spark, target).groupBy("database")
    return summary.join(counted.agg(F.sum("row_count").alias("rows_found")), "database")


def migrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a migrated table, every copy compared by content."""
    scratch = Scratch(spark, sf_dir)
    _two_databases(scratch)
    source, target = scratch.catalog("source"), scratch.catalog("target")
    migrate_databases(spark, "*", source, target, check=CONTENT)
    return read_table(spark, TableRef("texts", "documents", target))


def migration_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration that had ended after one database, run again twice with its ledger.

    Of the five tables the second run copies three, the third only the one that failed.
    """
    scratch = Scratch(spark, sf_dir)
    _two_databases(scratch)
    source, target = scratch.catalog("source"), scratch.catalog("target")
    ledger = f"{scratch.folder}/ledger"
    for selector in ("sales", "*", "*"):
        report = migrate_databases(spark, selector, source, target, ledger=ledger).report
    entries = Ledger(spark, ledger, source, target).entries().count()
    return without_paths(report).withColumn("entries", F.lit(entries).cast("bigint"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four databases: one is empty, one has a table that cannot be read."""
    scratch = Scratch(spark, sf_dir)
    _two_databases(scratch)
    for table in ("lineitem", "part"):
        scratch.register(table, "stock", "source")
    listed = catalog_inventory(spark, scratch.catalog("source"))
    stored = listed.where(~F.coalesce("is_temporary", F.lit(False)))
    return stored.withColumn("unreadable", F.col("reason").isNotNull()).drop("reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_scan_infer": csv_scan_infer,
    "csv_scan_schema": csv_scan_schema,
    "load_timestamp": load_timestamp,
    "folder_write_read": folder_write_read,
    "csv_to_parquet_etl": csv_to_parquet_etl,
    "etl_registered_table": etl_registered_table,
    "temp_view_scan": temp_view_scan,
    "csv_quarantine_good": csv_quarantine_good,
    "csv_quarantine_bad": csv_quarantine_bad,
    "table_scan": table_scan,
    "sql_table_scan": sql_table_scan,
    "current_database_scan": current_database_scan,
    "create_append_read": create_append,
    "append_twice": append_twice,
    "literal_rows_append": literal_rows_append,
    "insert_values_read": insert_values_read,
    "current_timestamp_once": current_timestamp_once,
    "empty_clone": empty_clone,
    "empty_clone_at_location": empty_clone_at_location,
    "create_or_replace": create_or_replace,
    "replace_from_itself": replace_from_itself,
    "row_count": row_counts,
    "first_n": first_n,
    "describe_table": describe,
    "drop_cleanup": drop_cleanup,
    "table_properties": properties,
    "precombine_latest": precombine_latest,
    "keyed_write_read": keyed_write_read,
    "keyed_registered_read": keyed_registered_read,
    "keyed_replace_read": keyed_replace_read,
    "keyed_published_read": keyed_published_read,
    "precombine_any_type": precombine_any_type,
    "copy_replace_verified": copy_replace_verified,
    "copy_replace_rows": copy_replace_rows,
    "copy_nested_rows": copy_nested_rows,
    "copy_append_renamed": copy_append_renamed,
    "copy_append_at_location": copy_append_at_location,
    "copy_replace_renamed": copy_replace_renamed,
    "copy_partitioned_rows": copy_partitioned_rows,
    "copy_sized_rows": copy_sized_rows,
    "copy_described": copy_described,
    "content_check": content_check,
    "count_check": count_check,
    "migrate_database": migrate_one_database,
    "migrate_databases": migrate_listed_databases,
    "migrate_all_databases": migrate_all_databases,
    "migration_summary": migration_summary,
    "migrated_rows": migrated_rows,
    "migration_resumed": migration_resumed,
    "catalog_inventory": inventory,
}


def entry(spark: SparkSession) -> DataFrame:
    """The CSV to Parquet load on the smallest data."""
    return csv_to_parquet_etl(spark, SMALLEST)


def _llm() -> tuple[dict, dict]:
    """Queries and SQL of the optional subpackage; nothing where it was taken out."""
    try:
        from lakehaul.llm.queries import QUERIES as llm_queries
        from lakehaul.llm.queries import SQL as llm_sql
    except ImportError:
        return {}, {}
    try:
        import corpus_pipeline
    except ImportError:
        pass
    else:
        llm_queries = {**llm_queries, "pipeline": corpus_pipeline.run}
        if corpus_pipeline.ORACLE_SQL:
            llm_sql = {**llm_sql, "pipeline": corpus_pipeline.ORACLE_SQL}
    return llm_queries, llm_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **_llm()[0]}


# --- SQL counterparts ---------------------------------------------------------

STAMP = "TIMESTAMP '2024-01-01 00:00:00' AS \"current_date\""
LATEST_EVENTS = """
    SELECT * FROM events
    QUALIFY row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""
COPIED = """
    SELECT '{database}' AS "database", 'completed' AS status, CAST(NULL AS VARCHAR) AS reason,
           '{table}' AS "table", count(*) AS source_count, count(*) AS dest_count,
           true AS succeeded
    FROM {table}"""
NOT_COPIED = """
    SELECT 'texts' AS "database", 'completed' AS status, 'failed' AS reason,
           'conversations' AS "table", CAST(NULL AS BIGINT) AS source_count,
           CAST(NULL AS BIGINT) AS dest_count, false AS succeeded"""
NO_TABLE = """
    SELECT '{database}' AS "database", '{status}' AS status, {reason} AS reason,
           CAST(NULL AS VARCHAR) AS "table", CAST(NULL AS BIGINT) AS source_count,
           CAST(NULL AS BIGINT) AS dest_count, CAST(NULL AS BOOLEAN) AS succeeded"""
COUNTED = """
    SELECT '{database}' AS "database", '{table}' AS "table", false AS is_temporary,
           count(*) AS row_count
    FROM {table}"""
TWO_DATABASES = {"sales": ("events", "orders"), "texts": ("documents", "embeddings")}


def _all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _each(template: str, databases: dict[str, tuple[str, ...]]) -> list[str]:
    return [
        template.format(database=database, table=table)
        for database, tables in databases.items()
        for table in tables
    ]


def _columns(columns: dict[str, str], name: str, counts: list[str]) -> str:
    """Column rows with counts beside them."""
    values = ", ".join(f"('{column}', '{kind}')" for column, kind in columns.items())
    return (
        f"SELECT {name}, data_type, {', '.join(counts)} "
        f"FROM (VALUES {values}) AS c({name}, data_type)"
    )


ORDERS_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}
PART_TYPES = {
    "p_partkey": "bigint",
    "p_name": "string",
    "p_brand": "string",
    "p_type": "string",
    "p_size": "int",
    "p_retailprice": "double",
}

ORACLE: dict[str, str] = {
    "csv_scan_infer": "SELECT * FROM orders",
    "csv_scan_schema": "SELECT * FROM lineitem",
    "load_timestamp": f"SELECT *, {STAMP} FROM lineitem",
    "folder_write_read": "SELECT * FROM documents",
    "csv_to_parquet_etl": f"SELECT *, {STAMP} FROM orders",
    "etl_registered_table": f"SELECT *, {STAMP} FROM orders",
    "temp_view_scan": f"SELECT *, {STAMP} FROM lineitem",
    "csv_quarantine_good": f"SELECT *, {STAMP} FROM orders WHERE o_orderkey % 7 <> 0",
    "csv_quarantine_bad": """
        SELECT o_orderkey, concat('o_custkey: ''c', o_custkey, ''' is no bigint') AS bad_reason,
               true AS from_file,
               (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS good_rows,
               (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS bad_rows
        FROM orders WHERE o_orderkey % 7 = 0""",
    "table_scan": "SELECT * FROM events",
    "sql_table_scan": "SELECT * FROM lineitem",
    "current_database_scan": "SELECT * FROM conversations",
    "create_append_read": "SELECT * FROM customer",
    "append_twice": "SELECT * FROM part UNION ALL SELECT * FROM part",
    "literal_rows_append": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id,
               strftime(o_orderdate, '%Y-%m-%d') AS creation_date,
               strftime(o_orderdate, '%Y-%m-%d') AS last_update_time
        FROM orders
        UNION ALL
        SELECT * FROM (VALUES
            ('pump-a', '2023-03-01', '2023-03-09T06:00:00.5Z'),
            ('pump-a', '2023-03-01', '2023-03-08T23:30:00.25Z'),
            ('pump-b', '2023-03-02', '2023-03-10T00:00:01Z')) AS v""",
    "insert_values_read": """
        SELECT c_custkey AS id, c_name AS data FROM customer
        UNION ALL SELECT CAST(-1 AS BIGINT), 'first row'
        UNION ALL SELECT CAST(-2 AS BIGINT), 'second row'""",
    "current_timestamp_once": """
        SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_times FROM orders""",
    "empty_clone": _columns(
        PART_TYPES,
        "column_name",
        ["CAST(0 AS BIGINT) AS rows_before", "(SELECT count(*) FROM part) AS rows_after"],
    ),
    "empty_clone_at_location": """
        SELECT CAST(0 AS BIGINT) AS rows_before, count(*) AS rows_after FROM customer""",
    "create_or_replace": "SELECT * FROM supplier",
    "replace_from_itself": "SELECT * FROM orders UNION ALL SELECT * FROM orders",
    "row_count": """
        SELECT 'frame' AS api, count(*) AS cnt FROM lineitem
        UNION ALL SELECT 'sql', count(*) FROM lineitem""",
    "first_n": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "describe_table": _columns(
        ORDERS_TYPES, "col_name", ["(SELECT count(*) FROM orders) AS n_rows"]
    ),
    "drop_cleanup": """SELECT 'supplier' AS "table", count(*) AS cnt FROM supplier""",
    "table_properties": """
        SELECT key, value, (SELECT count(*) FROM supplier) AS n_rows
        FROM (VALUES ('write.format.default', 'parquet'),
                     ('write.parquet.compression-codec', 'snappy'),
                     ('write.metadata.compression-codec', 'gzip')) AS p(key, value)""",
    "precombine_latest": LATEST_EVENTS,
    "keyed_write_read": LATEST_EVENTS,
    "keyed_registered_read": LATEST_EVENTS,
    "keyed_replace_read": """
        SELECT * FROM lineitem
        QUALIFY row_number() OVER (
            PARTITION BY l_partkey, l_suppkey
            ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1""",
    "keyed_published_read": LATEST_EVENTS,
    "precombine_any_type": """
        SELECT user_id, CAST(ts AS DATE) AS "day", coalesce(event_type, '') AS event_type, value
        FROM events
        QUALIFY row_number() OVER (
            PARTITION BY user_id
            ORDER BY CAST(ts AS DATE) DESC, coalesce(event_type, '') DESC, value DESC NULLS LAST) = 1""",
    "copy_replace_verified": """
        SELECT count(*) AS source_count, count(*) AS dest_count, true AS succeeded,
               count(*) AS rows_found
        FROM lineitem""",
    "copy_replace_rows": "SELECT * FROM orders",
    "copy_nested_rows": """
        SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
               unnest(embedding) AS val
        FROM embeddings""",
    "copy_append_renamed": "SELECT * FROM customer",
    "copy_append_at_location": "SELECT * FROM part UNION ALL SELECT * FROM part",
    "copy_replace_renamed": "SELECT * FROM pages",
    "copy_partitioned_rows": """
        SELECT *, 'l_returnflag,l_linestatus' AS partitioned_by FROM lineitem""",
    "copy_sized_rows": "SELECT * FROM orders",
    "copy_described": """
        SELECT *, (SELECT count(*) FROM customer) AS n_rows
        FROM (VALUES ('c_custkey', 'bigint', 'the key', NULL, false),
                     ('c_name', 'varchar(40)', NULL, NULL, false),
                     ('c_acctbal', 'double', NULL, '0.5D', false),
                     ('c_mktsegment', 'string', 'of the market', NULL, true))
             AS c(column_name, data_type, "comment", default_value, is_partition)""",
    "content_check": _all(
        [
            f"""SELECT '{column}' AS column_name, count(*) - count({column}) AS source_nulls,
                       count(*) - count({column}) AS target_nulls, {same} AS same_rows,
                       '{copy}' AS copy
                FROM documents"""
            for copy, same in (("same", "true"), ("changed", "false"))
            for column in ("doc_id", "text", "lang", "source", "n_chars")
        ]
    ),
    "count_check": "SELECT count(*) AS cnt, count(*) AS shared FROM documents",
    "migrate_database": _all(
        _each(COPIED, {"sales": ("customer", "lineitem", "nation", "orders", "supplier")})
    ),
    "migrate_databases": _all(
        [
            *_each(COPIED, TWO_DATABASES),
            NOT_COPIED,
            NO_TABLE.format(
                database="missing", status="skipped", reason="'database not found'"
            ),
        ]
    ),
    "migrate_all_databases": _all(
        [
            *_each(COPIED, TWO_DATABASES),
            NOT_COPIED,
            NO_TABLE.format(
                database="idle", status="completed", reason="CAST(NULL AS VARCHAR)"
            ),
        ]
    ),
    "migration_summary": """
        SELECT * FROM (VALUES
            ('sales', 'completed', CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT)),
            ('texts', 'completed', 3, 2, 1),
            ('idle', 'completed', 0, 0, 0)
        ) AS s("database", status, total_tables, successful, failed)
        JOIN (SELECT 'sales' AS "database",
                     (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) AS rows_found
              UNION ALL
              SELECT 'texts', (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings)
              UNION ALL
              SELECT 'idle', NULL) AS f USING ("database")""",
    "migrated_rows": "SELECT * FROM documents",
    "migration_resumed": "SELECT *, CAST(6 AS BIGINT) AS entries FROM ("
    + _all(
        [
            *_each(COPIED, TWO_DATABASES),
            NOT_COPIED,
            NO_TABLE.format(
                database="idle", status="completed", reason="CAST(NULL AS VARCHAR)"
            ),
        ]
    )
    + ")",
    "catalog_inventory": "SELECT *, row_count IS NULL AND \"table\" IS NOT NULL AS unreadable FROM ("
    + _all(
        [
            *_each(COUNTED, {**TWO_DATABASES, "stock": ("lineitem", "part")}),
            """SELECT 'texts', 'conversations', false, CAST(NULL AS BIGINT)""",
            """SELECT 'idle', CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN),
                      CAST(NULL AS BIGINT)""",
        ]
    )
    + ")",
}


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, **_llm()[1]}
