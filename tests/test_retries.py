"""Row counts when tasks fail and run again; needs a session that allows retries."""

import subprocess
import sys
from pathlib import Path

from tests.conftest import DATA

SCRIPT = f"""
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from lakehaul.operators import precombine
from lakehaul.sinks import replace_folder, write_folder

spark = (
    SparkSession.builder.master("local[2,4]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
orders = spark.read.parquet("{DATA}/orders.parquet").repartition(4)

def fails_once(batches):
    yield from batches
    task = TaskContext.get()
    if task.attemptNumber() == 0 and task.partitionId() % 2 == 0:
        raise RuntimeError("lost")

shaky = orders.mapInPandas(fails_once, orders.schema)
latest = precombine(shaky, ["o_custkey"], "o_orderdate")
out = sys.argv[1]
print("counts", write_folder(shaky, out + "/all"), replace_folder(latest, out + "/latest"))
"""


def test_rows_of_repeated_tasks_count_once(spark, given, tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path)],
        cwd=Path(__file__).parent.parent,
        capture_output=True,
        text=True,
        timeout=180,
    )
    customers = given("orders").select("o_custkey").distinct().count()
    assert f"counts 1500 {customers}" in done.stdout
    assert spark.read.parquet(str(tmp_path / "all")).count() == 1500
    assert spark.read.parquet(str(tmp_path / "latest")).count() == customers
