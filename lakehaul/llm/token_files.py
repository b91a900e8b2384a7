"""Token ids in Parquet files: list columns, small row groups, page indexes.

A file holds a row per document in ascending id order: the id, the number of token ids
before it in the file, their number, and the ids.  Ids are written with a dictionary
where they repeat (a vocabulary is far smaller than a file) and metadata without one and in
the second page version, whose integers are delta-encoded.  Row groups and pages are kept small, and the
writer adds a page index; so a reader that wants the lengths reads no ids, and one that wants a
range of documents reads the pages that hold it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakehaul.llm import anchors
from lakehaul.llm.shared import shared_folder
from lakehaul.llm.tokens import encoder

#: Bytes of a row group and of a page, and rows of a page, at most.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 8 << 20, 256 << 10, 2_000
#: Signs of a text by which rows of one id are divided among files.
RANGE_SIGNS = 64
#: Bytes of texts encoded together, about; a longer text is encoded alone.
TOGETHER = 4 << 20

IDS = "doc_id bigint, within bigint, n_tokens bigint, ids array<int>"


def encode_rows(path: str, by_space: bool, end: int) -> Callable:
    def ids_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokens = encoder(path, by_space)
        if not by_space:
            return tokens.encode_words(texts)
        rows = tokens.encode(texts.to_pylist())
        return np.frombuffer(b"".join(rows), "<u4"), np.array([len(x) // 4 for x in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy()
            for rows in anchors.batches(sizes, TOGETHER):
                part = batch.slice(rows.start, rows.stop - rows.start)
                ids, lengths = ids_of(part.column("text"))
                ends = np.cumsum(lengths)
                flat = np.insert(ids, ends, end).view(np.int32)
                lengths = lengths + 1
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(before + offsets[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                    ],
                    ["doc_id", "within", "n_tokens", "ids"],
                )
                before += int(offsets[-1])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int,
    by_space: bool,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes every whole text, appends ``end`` and writes the ids to a folder of files.

    The files' order, by the number in their names, is the order of ids; so is the order of rows
    in them.
    A null text is empty and has only ``end``.  Rows without an id come first.  Rows of
    one id are kept, and ordered by their texts.  Other columns are not written.  An
    empty table gives a folder with a schema and no rows.
    """
    ordered = (
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        # Rows without an id, or of one id, are divided by how their texts begin.
        .repartitionByRange("doc_id", F.substring("text", 1, RANGE_SIGNS))
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ordered.mapInArrow(encode_rows(tokenizer, by_space, end), IDS)
        .write.option("maxRecordsPerFile", 0)  # A file per task: running sums are a task's.
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#within", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, and ``start``: the ids of all documents before.

    Starts come from the metadata columns alone: each file holds its own running sums,
    and the totals of the files, a row per file, are added up in their order.  These few rows
    are broadcast: ids are not shuffled to be read.
    """
    rows = spark.read.schema(IDS).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    files = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(
        F.col("file").alias("of"), F.coalesce(F.sum("total").over(files), F.lit(0)).alias("ahead")
    )
    return rows.join(F.broadcast(ahead), F.col("file") == F.col("of")).select(
        "doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids"
    )


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the unsigned CRC-32 of their ids, as little-endian 32-bit numbers."""
    for batch in batches:
        ids = batch.column("ids")
        data = memoryview(ids.values.cast(pa.int32()).buffers()[1])
        first = ids.values.offset
        ends = ids.offsets.to_pylist()
        sums = [
            zlib.crc32(data[4 * (first + a) : 4 * (first + b)])
            for a, b in zip(ends[:-1], ends[1:], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end=1, by_space=False)
    return read_token_files(spark, path).mapInArrow(
        checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
