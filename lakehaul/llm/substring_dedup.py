"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

Each bucket of text (``repeats.py``) is the reference for its own pieces.  The
reference is divided into blocks; the index of a block holds the places of every seed
(``width`` words) in it.  A piece is parsed from the left: the seed at hand is looked up
in the index of every block and extended, word by word, from its first place that is
not the piece's own; the match is a factor.  Factors have ``width`` words or more, shorter ones
being literals of one word.  A repeat that straddles the end of a factor matches at
another place than the factor does, so the parse goes on not behind the factor but
``width - 1`` words before its end: with the first window that the factor does not
hold.  The words of all factors are the words of all repeated windows.

All pieces of a bucket are parsed side by side, a numpy step at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm import anchors
from lakehaul.llm.repeats import MOST_CONTENTS, Unit, merged_spans, repeated_spans, text_bytes

#: Words of a reference block.
BLOCK_WORDS = 1 << 17

CUT = "key struct<id:bigint,check:bigint>, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string"


class ReferenceBlock:
    """Where every seed of a stretch of the reference begins."""

    def __init__(self, seeds: np.ndarray, places: np.ndarray):
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.places = places[order]

    def other_place(self, seeds: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each seed its first place that isn't ``own``; -1 if there is none."""
        found = np.full(len(seeds), -1, dtype=np.int64)
        if len(self.seeds):
            at = np.searchsorted(self.seeds, seeds)
            for _ in range(2):  # the first place may be the own one, the second is not
                near = np.minimum(at, len(self.seeds) - 1)
                hit = (at < len(self.seeds)) & (self.seeds[near] == seeds) & (found < 0)
                place = self.places[near]
                found = np.where(hit & (place != own), place, found)
                at = at + 1
        return found


def parse(pieces: list[bytes], width: int, block_words: int = BLOCK_WORDS) -> list[np.ndarray]:
    """For every window of every piece, whether a factor holds it."""
    data = np.frombuffer(b" ".join(pieces), np.uint8)
    starts, ends = anchors.words_of(data)
    words = anchors.stretch_hashes(anchors.prefix_sums(anchors.BYTE_CODES[data]), starts, ends)
    sizes = np.cumsum([len(p) + 1 for p in pieces])
    rows = np.searchsorted(sizes, starts, side="right")
    counts = np.bincount(rows, minlength=len(pieces)).astype(np.int64)
    stops = np.cumsum(counts)
    seeds = anchors.gram_hashes(anchors.prefix_sums(words), width)
    windows = np.flatnonzero(np.repeat(stops, counts) - np.arange(len(words)) >= width)
    blocks = [
        ReferenceBlock(seeds[part], part)
        for at in range(0, len(words), block_words)
        if len(part := windows[(windows >= at) & (windows < at + block_words)])
    ]
    stop_of = np.repeat(stops, counts)
    held = np.zeros(len(words) + 1, dtype=np.int32)
    at = stops - counts
    at = at[counts >= width]
    while len(at):
        place = np.full(len(at), -1, dtype=np.int64)
        for block in blocks:
            open_ = np.flatnonzero(place < 0)
            if not len(open_):
                break
            place[open_] = block.other_place(seeds[at[open_]], at[open_])
        length = np.zeros(len(at), dtype=np.int64)
        growing = np.flatnonzero(place >= 0)
        length[growing] = width
        while len(growing):
            a, b = at[growing] + length[growing], place[growing] + length[growing]
            room = (a < stop_of[at[growing]]) & (b < stop_of[place[growing]])
            growing, a, b = growing[room], a[room], b[room]
            growing = growing[words[a] == words[b]]
            length[growing] += 1
        hit = length > 0
        first, step = at[hit], length[hit] - width + 1
        np.add.at(held, first, 1)
        np.add.at(held, first + step, -1)
        stop = stop_of[at]
        at = at + np.where(hit, length - width + 1, 1)
        at = at[at + width <= stop]
    flags = np.cumsum(held)[:-1] > 0
    return [
        flags[stop - count : max(stop - count, stop - width + 1)]
        for stop, count in zip(stops.tolist(), counts.tolist(), strict=True)
    ]


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = text_bytes(batch.column("text"))
        found = batch.column("spans").to_pylist()
        counts, spans, kept = [], [], []
        for row in range(batch.num_rows):
            words = data[places[row] : places[row + 1]].tobytes().split()
            own, at, parts = merged_spans(found[row]), 0, []
            for start, end in own:
                parts += words[at:start]
                at = end
            parts += words[at:]
            counts.append(len(words))
            spans.append([{"start": s, "end": e} for s, e in own])
            kept.append(b" ".join(parts).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array(counts, pa.int64()),
                pa.array(spans, kind),
                pa.array(kept, pa.string()),
            ],
            ["key", "n_words", "spans", "kept"],
        )


def substring_dedup(
    docs: DataFrame,
    width: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_contents: int = MOST_CONTENTS,
) -> DataFrame:
    """Removes each word covered by a ``width``-word window that starts elsewhere too.

    Returns a row per row of ``docs``: the id, ``n_words``, ``spans`` (word ranges that
    were removed, maximal and in order) and ``kept`` (the other words, one space
    between).  Words are what lies between spaces and the codes 9 to 13, unchanged.
    Other columns are not looked at and not returned.  A null text has no words; texts
    of fewer than ``width`` words are kept; rows with one id, or none, are documents of
    their own, and equal rows remove each other's text.  An empty table gives no rows.
    """
    unit = Unit(words=True, width=width, gram=max(1, min(8, width // 4)))
    solve = functools.partial(parse, width=width)
    rows = repeated_spans(docs, id_col, text_col, unit, solve, most_contents)
    return rows.mapInArrow(cut_words, CUT).select(
        F.col("key.id").alias(id_col), "n_words", "spans", "kept"
    )


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
    )
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
    )
