"""Removal of repeated byte strings by merging the suffix indexes of shards.

Each bucket of text (``repeats.py``) is divided into shards, and each shard sorts its
own suffixes only.  The shards' indexes are then merged by refining their interleave:

* At depth h all suffixes of the bucket lie in blocks of equal first h bytes, the
  blocks in lexicographic order.  A shard knows its blocks in its own sorted order.
* A round doubles the depth.  The letter that the transform holds for a suffix is here
  the block of the h bytes before it, so one step back over such a letter (the LF
  step, taken h bytes at a time) splits each block by the block h bytes further on.
  Every shard orders its pairs of blocks; the sorted lists of the shards are
  interleaved and common pairs become one block.  This is prefix doubling: each round
  sorts the pairs of all live suffixes again.  No Burrows-Wheeler transform and no array
  of common prefixes is built.
* A block with one suffix in the whole bucket is done: its common prefix with any other
  suffix is shorter than the depth.  It leaves the later rounds.
* Blocks that are left at depth ``width`` are the intervals of suffixes whose common
  prefix is ``width`` or longer: every suffix in them starts a repeated string.

With the width not a power of two the last round joins two overlapping blocks.  Rounds
number log2(width), 6 for 400 bytes, instead of one per byte.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm.repeats import MOST_CONTENTS, Unit, merged_spans, repeated_spans, text_bytes

#: Bytes of a shard, whose suffixes are sorted together.
SHARD_BYTES = 1 << 19

CUT = "key struct<id:bigint,check:bigint>, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def first_letters(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Every 8 consecutive bytes as one number, in lexicographic order."""
    letters = data.astype(np.uint64)
    for bits in (1, 2, 4):
        letters = (letters[:-bits] << np.uint64(8 * bits)) | letters[bits:]
    return letters, 8


def interleave(letters: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of equal letters over all shards: each suffix's block, and their sizes.

    ``cuts`` divides the letters by shard.  Each shard is sorted alone; of the shards
    only the lists of distinct letters are merged.
    """
    lists, places, counts = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, place, count = np.unique(letters[a:b], return_inverse=True, return_counts=True)
        lists.append(own)
        places.append(place)
        counts.append(count)
    _, merged = np.unique(np.concatenate(lists), return_inverse=True)
    sizes = np.bincount(merged, weights=np.concatenate(counts)).astype(np.int64)
    starts = np.cumsum([0, *map(len, lists)])
    blocks = np.concatenate(
        [merged[s : s + len(own)][place] for s, own, place in zip(starts, lists, places, strict=False)]
    )
    return blocks, sizes


def repeated_windows(pieces: list[bytes], width: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For every window of every piece, whether its bytes start anywhere else too."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    left = np.repeat(ends, lengths) - np.arange(len(data))  # bytes up to the piece's end
    # Shards end with a piece.
    marks = np.arange(shard_bytes, len(data) + shard_bytes, shard_bytes)
    bounds = np.unique(np.append(0, ends[np.minimum(np.searchsorted(ends, marks), len(ends) - 1)]))

    if width < 8:
        raise ValueError("a repeated string has 8 bytes at least")
    letters, depth = first_letters(np.append(data, np.zeros(7, np.uint8)))
    alive = np.flatnonzero(left >= depth)
    letters = letters[alive]
    block_of = np.full(len(data), -1, dtype=np.int64)
    while True:
        if not len(alive):
            break
        blocks, sizes = interleave(letters, np.searchsorted(alive, bounds))
        shared = sizes[blocks] > 1
        known = alive[shared]
        block_of[known] = blocks[shared]
        if depth == width:
            alive = known
            break
        step = min(depth, width - depth)
        alive = known[left[known] >= depth + step]
        alive = alive[block_of[alive + step] >= 0]
        letters = block_of[alive] * len(sizes) + block_of[alive + step]
        block_of[known] = -1
        depth += step
    flags = np.zeros(len(data), dtype=bool)
    flags[alive] = True
    return [
        flags[end - length : end - width + 1]
        for end, length in zip(ends.tolist(), lengths.tolist(), strict=True)
    ]


def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = text_bytes(batch.column("text"))
        found = batch.column("spans").to_pylist()
        spans, kept = [], []
        for row in range(batch.num_rows):
            text = data[places[row] : places[row + 1]].tobytes()
            own, at, parts = merged_spans(found[row]), 0, []
            for start, end in own:
                parts.append(text[at:start])
                at = end
            parts.append(text[at:])
            spans.append([{"start": s, "end": e} for s, e in own])
            kept.append(b"".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array(np.diff(places)),
                pa.array(spans, kind),
                pa.array(kept, pa.binary()),
            ],
            ["key", "n_bytes", "spans", "kept"],
        )


def suffix_dedup(
    docs: DataFrame,
    width: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_contents: int = MOST_CONTENTS,
) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that starts elsewhere too.

    Returns a row per row of ``docs``: the id, ``n_bytes``, ``spans`` (byte ranges that
    were removed, maximal and in order) and ``kept`` (the other bytes).  Other columns
    of ``docs`` are not looked at and not returned.  A null text counts as empty; texts
    shorter than ``width`` are kept; rows with one id, or none, are documents of their
    own, and equal rows remove each other's text.  An empty table gives no rows.
    """
    unit = Unit(words=False, width=width, gram=max(8, min(64, width // 4)))
    solve = functools.partial(repeated_windows, width=width)
    rows = repeated_spans(docs, id_col, text_col, unit, solve, most_contents)
    return rows.mapInArrow(cut_bytes, CUT).select(
        F.col("key.id").alias(id_col), "n_bytes", "spans", "kept"
    )


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
    )
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
