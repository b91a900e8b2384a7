"""Exact duplicates by a cuckoo-filter index over live digests.

Texts are normalised and digested on Spark, and an exact ``groupBy`` makes one row of each
digest, partly before the shuffle, so a text with very many copies is no hot key.  The
digests are dealt to shards by hash.  Each of them comes to its shard once: here the index
finds no further duplicate, and hits and deletions occur only where it is fed rows that
were not aggregated (as in the tests).  Each shard keeps

* a cuckoo filter: four 16-bit fingerprints a bucket, two buckets a digest, the second
  found from the first and the fingerprint alone, so entries can be moved and deleted;
* the bucketed content behind it: the whole SHA-256, the text's length, the row that
  stays and the number of rows.

A digest that the filter doesn't know is new.  A hit is compared with the content, so a
fingerprint met by chance is no duplicate.  Insertion moves entries between their two
buckets; when that fails, the filter has overflowed and is built anew, twice as large,
from the stored keys.  When a smaller id turns up for a live digest, the old entry is
deleted and the new one inserted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehaul.llm.shared import BREAK, row_key, rows_of_keys, written

#: Distinct digests that a shard gets, about.
SHARD_DIGESTS = 100_000

INDEX = "digest binary, keep_id bigint, group_size bigint"


class CuckooFilter:
    """Fingerprints of live keys: may say yes to a key it doesn't hold, never no to one
    it holds.  Keys are uniformly distributed bytes, 12 at least."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 1024):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.mask = buckets - 1
        self.buckets: list[list[int]] = [[] for _ in range(buckets)]
        self.turn = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        place = int.from_bytes(key[4:12], "little") & self.mask
        return mark, place, self._other(place, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        return mark in self.buckets[one] or mark in self.buckets[two]

    def insert(self, key: bytes) -> bool:
        """False if the filter has overflowed; it then has to be built anew."""
        mark, one, two = self._places(key)
        for place in (one, two):
            if len(self.buckets[place]) < self.SLOTS:
                self.buckets[place].append(mark)
                return True
        place = one
        for _ in range(self.KICKS):
            bucket = self.buckets[place]
            self.turn += 1
            slot = self.turn % self.SLOTS
            mark, bucket[slot] = bucket[slot], mark
            place = self._other(place, mark)
            if len(self.buckets[place]) < self.SLOTS:
                self.buckets[place].append(mark)
                return True
        return False

    def delete(self, key: bytes) -> None:
        """Removes a key that was inserted."""
        mark, one, two = self._places(key)
        for place in (one, two):
            if mark in self.buckets[place]:
                self.buckets[place].remove(mark)
                return


class DigestIndex:
    """Live digests, each with the row that stays and the number of its rows."""

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.content: dict[bytes, tuple[int, int | None, int]] = {}

    def _resize(self) -> None:
        """A larger filter from the stored keys, and a larger one if that overflows too."""
        buckets = 2 * (self.filter.mask + 1)
        while True:
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(key) for key in self.content):
                return
            buckets *= 2

    def insert(self, key: bytes, n_bytes: int, keep: int | None, rows: int) -> None:
        self.content[key] = (n_bytes, keep, rows)
        if not self.filter.insert(key):
            self._resize()

    def delete(self, key: bytes) -> None:
        del self.content[key]
        self.filter.delete(key)

    def add(self, key: bytes, n_bytes: int, keep: int | None, rows: int) -> None:
        """Rows of one text: a new digest, or more rows of a live one."""
        if key not in self.filter or key not in self.content:
            self.insert(key, n_bytes, keep, rows)
            return
        size, kept, count = self.content[key]
        if size != n_bytes:
            raise ValueError("two texts have one SHA-256")
        if keep is not None and (kept is None or keep < kept):
            self.delete(key)
            self.insert(key, n_bytes, keep, count + rows)
        else:
            self.content[key] = (size, kept, count + rows)


def index_shard(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = DigestIndex()
    for rows in batches:
        ids = [None if missing else int(x) for x, missing in zip(rows["keep_id"], rows["keep_id"].isna(), strict=True)]
        for key, size, keep, count in zip(rows["digest"], rows["n_bytes"], ids, rows["rows"], strict=True):
            index.add(bytes(key), int(size), keep, int(count))
    items = list(index.content.items())
    for at in range(0, len(items), 20_000):
        part = items[at : at + 20_000]
        yield pd.DataFrame(
            {
                "digest": [key for key, _ in part],
                "keep_id": pd.array([keep for _, (_, keep, _) in part], dtype="Int64"),
                "group_size": [count for _, (_, _, count) in part],
            }
        )


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BREAK, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_digests: int = SHARD_DIGESTS,
) -> DataFrame:
    """For every row of ``docs``, the row of its text that stays.

    Texts are equal when they are after each run of spaces and of the codes 9 to 13 became
    one space; a null text is empty.  Returns the id, ``check`` (hash of the text as it is), ``keep_id`` (the smallest id of the
    text's rows), ``group_size`` (how many rows), ``kept`` and ``text_sha256`` (of the
    normalised text).  A row without an id stays only if no row of its text has one.  Of
    repeated rows (one text, one id, or none) all are marked ``kept`` or none is.  Other
    columns are not looked at.  An empty table gives no rows.
    """
    text = normalised(text_col)
    rows = written(
        docs.select(
            row_key(id_col, text_col).alias("key"), F.encode(text, "UTF-8").alias("data")
        ).select(
            "key",
            F.col("key.id").alias("id"),
            F.octet_length("data").cast("bigint").alias("n_bytes"),
            F.unhex(F.sha2("data", 256)).alias("digest"),
        ),
        "digests",
    )
    digests = rows.groupBy("digest", "n_bytes").agg(
        F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("rows")
    )
    shards = max(1, -(-rows.count() // shard_digests))
    index = (
        digests.repartition(shards, "digest")
        .select("digest", "n_bytes", "keep_id", "rows")
        .mapInPandas(index_shard, INDEX)
    )
    return rows.join(index, "digest").select(
        F.col("id").alias(id_col),
        F.col("key.check").alias("check"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that of the smallest id."""
    found = exact_dedup(docs, id_col, text_col).where("kept")
    key = F.struct(F.col(id_col).alias("id"), "check").alias("key")
    # Rows of one id may differ in their white space: one of them stays.
    keys = found.select("text_sha256", key).groupBy("text_sha256").agg(F.min("key").alias("key"))
    return rows_of_keys(docs, written(keys.select("key"), "kept"), id_col, text_col)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("check")


SQL = r"""
    WITH d AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
        FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d"""
