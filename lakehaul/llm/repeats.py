"""What the two repeat finders share: routing equal windows to one place.

1. Every document is cut into runs of windows with one anchor (``anchors.py``).
2. Anchors are counted.  A window whose anchor occurs once occurs once.  Where all
   runs of an anchor have one content and there are two at least, all their windows
   are repeated, whatever the number of copies: nothing but counts is moved.
3. The rest are anchors seen with several contents: near copies around an edit,
   passages inside other text.  One run per distinct content is fetched and dealt to
   buckets by anchor; a bucket holds every place where its windows can occur, and the
   operator's own method finds the repeated windows in it.
4. Verdicts go back to all runs of the content and are merged into spans.

An anchor with more than ``MOST_CONTENTS`` distinct contents is not gathered: its
windows are hashed one by one and counted, which is exact and has no large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm import anchors
from lakehaul.llm.shared import keyed_texts, written

#: Distinct contents of one anchor that one task may gather.
MOST_CONTENTS = 4096
#: Symbols that one numpy pass works on.
PASS_SYMBOLS = 1 << 18
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 3 << 20

RUNS = "key struct<id:bigint,check:bigint>, first bigint, windows bigint, anchor bigint, content bigint, places bigint"
PIECES = "anchor bigint, content bigint, crowded boolean, piece binary"
FOUND = "anchor bigint, content bigint, starts array<int>, ends array<int>"


@dataclass(frozen=True)
class Unit:
    """Windows of ``width`` bytes, or of ``width`` words."""

    words: bool
    width: int
    gram: int

    def symbols(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts laid end to end, and how many each text has."""
        if not self.words:
            return anchors.BYTE_CODES[data], lengths
        starts, ends, counts = words_by_row(data, lengths)
        sums = anchors.prefix_sums(anchors.BYTE_CODES[data])
        return anchors.stretch_hashes(sums, starts, ends), counts


def words_by_row(
    data: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end; no word crosses from one text to the next."""
    starts, ends = anchors.words_of(data)
    bounds = np.cumsum(lengths)[:-1]
    # A word over a bound is cut there.
    at = np.searchsorted(starts, bounds, side="right") - 1
    cut = (at >= 0) & (bounds < ends[at]) & (bounds > starts[at]) if len(starts) else bounds < 0
    extra = np.unique(bounds[cut])
    starts = np.sort(np.concatenate([starts, extra]))
    ends = np.sort(np.concatenate([ends, extra]))
    rows = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return starts, ends, np.bincount(rows, minlength=len(lengths)).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value begins, one end more."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    if data is None:
        return np.empty(0, dtype=np.uint8), places - places[0]
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def find_runs(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column("text"))
            lengths = np.diff(places)
            for part in anchors.batches(lengths, PASS_SYMBOLS):
                symbols, counts = unit.symbols(
                    data[places[part.start] : places[part.stop]], lengths[part]
                )
                runs = anchors.window_runs(symbols, counts, unit.width, unit.gram)
                keys = batch.column("key").take(pa.array(runs["row"] + part.start))
                rest = [pa.array(runs[n]) for n in ("first", "windows", "anchor", "content", "places")]
                yield pa.RecordBatch.from_arrays(
                    [keys, *rest], ["key", "first", "windows", "anchor", "content", "places"]
                )

    return find


def cut_pieces(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The symbols of the wanted runs, as bytes; words come with one space between."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch.column("text"))
            for row in range(batch.num_rows):
                text = data[places[row] : places[row + 1]]
                wanted = batch.column("wanted")[row].as_py()
                if unit.words:
                    starts, ends = anchors.words_of(text)
                out = []
                for want in wanted:
                    first, last = want["first"], want["first"] + want["windows"] + unit.width - 1
                    if unit.words:
                        out.append(
                            b" ".join(
                                text[a:b].tobytes()
                                for a, b in zip(starts[first:last], ends[first:last], strict=True)
                            )
                        )
                    else:
                        out.append(text[first:last].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["anchor"] for w in wanted], pa.int64()),
                        pa.array([w["content"] for w in wanted], pa.int64()),
                        pa.array([w["crowded"] for w in wanted], pa.bool_()),
                        pa.array(out, pa.binary()),
                    ],
                    ["anchor", "content", "crowded", "piece"],
                )

    return cut


def flags_to_ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()


def solve_bucket(solve: Callable) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "content"], ignore_index=True)
        ranges = [flags_to_ranges(flags) for flags in solve(rows["piece"].tolist())]
        return pd.DataFrame(
            {
                "anchor": rows["anchor"],
                "content": rows["content"],
                "starts": [r[0] for r in ranges],
                "ends": [r[1] for r in ranges],
            }
        )

    return run


def hash_windows(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("piece")[row].as_py(), np.uint8)
                symbols, _ = unit.symbols(data, np.array([len(data)]))
                hashes = anchors.gram_hashes(anchors.prefix_sums(symbols), unit.width)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(batch.column("anchor")[row], n),
                        pa.repeat(batch.column("content")[row], n),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(hashes.view(np.int64)),
                    ],
                    ["anchor", "content", "at", "hash"],
                )

    return hashed


def by_counting(pieces: DataFrame, unit: Unit) -> DataFrame:
    """Repeated windows of anchors with too many contents for one task."""
    windows = pieces.mapInArrow(
        hash_windows(unit), "anchor bigint, content bigint, at int, hash bigint"
    )
    again = windows.groupBy("anchor", "hash").count().where("count > 1").drop("count")
    return (
        windows.join(again, ["anchor", "hash"])
        .groupBy("anchor", "content")
        .agg(F.collect_set("at").alias("starts"))
        .select("anchor", "content", "starts", F.transform("starts", lambda x: x + 1).alias("ends"))
    )


def repeated_spans(
    docs: DataFrame, id_col: str, text_col: str, unit: Unit, solve: Callable, most_contents: int
) -> DataFrame:
    """``key``, ``text`` and ``spans`` (in symbols) of every row of ``docs``.

    Spans may overlap and are in no order; rows without any have null.  ``solve`` gets
    pieces of text and gives, for each, a flag per window.
    """
    texts = keyed_texts(docs, id_col, text_col)
    runs = written(texts.mapInArrow(find_runs(unit), RUNS), "runs")
    repeated = (
        runs.groupBy("anchor")
        .agg(
            F.sum("places").alias("n"),
            F.count(F.lit(1)).alias("runs"),
            F.min("content").alias("least"),
            F.max("content").alias("most"),
        )
        .where("n > 1")
        .select("anchor", F.expr("runs > 1 AND least = most").alias("same"))
    )
    known = written(runs.join(repeated, "anchor"), "repeated-runs")
    whole = known.where("same").select(
        "key", F.col("first").alias("start"), (F.col("first") + F.col("windows")).alias("end")
    )
    mixed = known.where("NOT same")
    size = mixed.agg(F.sum(F.col("windows") + (unit.width - 1))).first()[0] or 0
    buckets = max(1, -(-int(size) * (8 if unit.words else 1) // BUCKET_BYTES))

    contents = mixed.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("key", "first", "windows")).alias("one"),
    )
    crowds = contents.groupBy("anchor").agg((F.count(F.lit(1)) > most_contents).alias("crowded"))
    contents = written(contents.join(crowds, "anchor"), "contents")
    wanted = (
        contents.select("one.*", "anchor", "content", "crowded")
        .groupBy("key")
        .agg(
            F.collect_list(F.struct("first", "windows", "anchor", "content", "crowded")).alias(
                "wanted"
            )
        )
    )
    pieces = (
        texts.join(wanted, "key").select("text", "wanted").mapInArrow(cut_pieces(unit), PIECES)
    )
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")
    verdicts = (
        pieces.where("NOT crowded")
        .select("anchor", "content", "piece", bucket)
        .groupBy("bucket")
        .applyInPandas(solve_bucket(solve), FOUND)
    )
    if not contents.where("crowded").isEmpty():
        verdicts = verdicts.union(by_counting(pieces.where("crowded"), unit))

    judged = mixed.join(contents.select("anchor", "content", "copies"), ["anchor", "content"])
    copied = judged.where("copies > 1").select(
        "key", F.col("first").alias("start"), (F.col("first") + F.col("windows")).alias("end")
    )
    single = (
        judged.where("copies = 1")
        .join(verdicts, ["anchor", "content"])
        .select("key", "first", F.explode(F.arrays_zip("starts", "ends")).alias("range"))
        .select(
            "key",
            (F.col("first") + F.col("range.starts")).alias("start"),
            (F.col("first") + F.col("range.ends")).alias("end"),
        )
    )
    span = F.struct("start", (F.col("end") + (unit.width - 1)).alias("end"))
    spans = (
        whole.union(copied).union(single).groupBy("key").agg(F.collect_set(span).alias("spans"))
    )
    return texts.join(spans, "key", "left")


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out
