"""Intermediate tables in the folder that the driver and all executors share, and what one worker
process holds."""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: a space, or one of the codes 9 to 13.
BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once, written to the shared folder and read back.

    This cuts the lineage: a lost executor costs no more than the tasks it ran.  The
    files stay as long as the checkpoint folder does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What this worker process holds from task to task, by operator.
_HELD: dict[str, dict] = {}


def held_by_worker(owner: str) -> dict:
    """A dict that lasts from task to task of ``owner`` in this worker process.

    The process runs the tasks of other operators too.  What they held goes first, so that an
    executor never has the tables of two operators in memory.
    """
    if owner not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            release_unused()
        _HELD[owner] = {}
    return _HELD[owner]


def release_unused() -> None:
    """Gives memory that this process has freed back to the system."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def giving_back(run: Callable) -> Callable:
    """``run``, a function of a task's batches, which leaves no freed memory with the worker process.

    The process waits for its next task for a minute or longer, while the executor runs stages
    without Python.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_unused()

    return task


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` and ``text`` (null: empty) of every row.

    The key is the id together with a hash of the text, so that rows with one id (or
    without any) and different texts stay apart.  Equal rows have equal keys.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("check")).alias("key"),
        text.alias("text"),
    )


def row_key(id_col: str, text_col: str) -> Column:
    """The key of ``keyed_texts``, of a table with other columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("check"))


def rows_of_keys(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs``, with its columns, for each ``key``; keys are distinct."""
    packed = docs.select(row_key(id_col, text_col).alias("key"), F.struct(*docs.columns).alias("row"))
    return packed.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
