"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A solution is a set of bins, not an assignment: crossover takes whole bins.  A child
gets the best-filled bins of one parent put into a copy of the other; bins of the copy
that hold any of their documents are removed, and the documents that lose their bin are
put back best-fit, longest first.  Solutions are judged by the number of bins, then by
how unevenly they are filled (the sum of squared fillings).

Pieces are dealt to shards by hash, so one task never holds more than a shard.  On a
shard two islands evolve from different starts and exchange their elites every few
generations.  Then the shards migrate: bins that are nearly full stay as they are,
and the documents of all other bins go, by hash, to fewer shards, where the same is done
once more.  Each shard wastes part of one bin or so, and shards hold thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm import anchors
from lakehaul.llm.shared import release_unused, written
from lakehaul.llm.tokens import encoder

#: Pieces of a shard, about.
SHARD_PIECES = 20_000
#: Solutions of an island, generations, and generations between migrations.
SOLUTIONS, GENERATIONS, MIGRATE = 3, 6, 3
#: Bins filled to this share stay when the rest migrates.
NEARLY_FULL = 0.995
#: Bytes of texts encoded together, about; a longer text is encoded alone.  A worker holds
#: some twenty times as many at once.
TOGETHER = 4 << 20

PIECES = "id bigint, row_check bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint, settled boolean"


class Packing:
    """Bins of items, found by their free room."""

    def __init__(self, lengths: list[int], room: int):
        self.lengths = lengths
        self.room = room
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_free: list[list[int]] = [[] for _ in range(room + 1)]
        self.mask = 0  # bit f: some bin may have f free
        self.next = 0

    def add_bin(self, items: list[int], free: int) -> None:
        name = self.next
        self.next += 1
        self.bins[name] = items
        self._set_free(name, free)

    def _set_free(self, name: int, free: int) -> None:
        self.free[name] = free
        self.by_free[free].append(name)
        self.mask |= 1 << free

    def best_fit(self, item: int) -> None:
        """Puts an item where the least room is left."""
        need = self.lengths[item]
        while True:
            open_ = self.mask >> need
            if not open_:
                self.add_bin([item], self.room - need)
                return
            free = need + ((open_ & -open_).bit_length() - 1)
            names = self.by_free[free]
            while names:
                name = names.pop()
                if self.free.get(name) == free:
                    self.bins[name].append(item)
                    self._set_free(name, free - need)
                    return
            self.mask &= ~(1 << free)

    def score(self) -> tuple[int, float]:
        """Smaller is better."""
        full = sum((1 - f / self.room) ** 2 for f in self.free.values())
        return len(self.bins), -full


def packed(lengths: list[int], room: int, order: list[int]) -> Packing:
    out = Packing(lengths, room)
    for item in order:
        out.best_fit(item)
    return out


def crossover(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """The mother's bins, after a share of the father's best-filled ones were put in."""
    names = sorted(father.bins, key=lambda n: (father.free[n], n))
    names = names[: max(1, len(names) // 2)]
    chosen = [names[i] for i in np.flatnonzero(rng.random(len(names)) < 0.4)]
    taken = {item for name in chosen for item in father.bins[name]}
    child = Packing(mother.lengths, mother.room)
    for name in chosen:
        child.add_bin(list(father.bins[name]), father.free[name])
    lost: list[int] = []
    for name, items in mother.bins.items():
        if taken.isdisjoint(items):
            child.add_bin(list(items), mother.free[name])
        else:
            lost += [i for i in items if i not in taken]
    lost.sort(key=lambda i: (-mother.lengths[i], i))
    for item in lost:
        child.best_fit(item)
    return child


def evolve(lengths: list[int], room: int, seed: int) -> list[list[int]]:
    """Bins of item numbers; no bin holds more than ``room``."""
    rng = np.random.default_rng(seed)
    array = np.array(lengths)
    lower = -(-int(array.sum()) // room)
    islands = []
    for number in range(2):
        solutions = []
        for k in range(SOLUTIONS):
            # Longest first, the first time exactly and then with some disorder.
            noise = rng.random(len(array)) * (0.0 if number + k == 0 else room * 0.04 * k + 1)
            order = np.lexsort((np.arange(len(array)), -(array + noise)))
            solutions.append(packed(lengths, room, order.tolist()))
        islands.append(sorted(solutions, key=Packing.score))
    for generation in range(1, GENERATIONS + 1):
        if min(s[0].score()[0] for s in islands) <= lower:
            break
        for solutions in islands:
            a, b = rng.permutation(len(solutions))[:2]
            first, second = sorted((int(a), int(b)))
            solutions.append(crossover(solutions[first], solutions[second], rng))
            solutions.sort(key=Packing.score)
            solutions.pop()
        if generation % MIGRATE == 0:
            elites = [s[0] for s in islands]
            for solutions, elite in zip(islands, reversed(elites), strict=True):
                solutions[-1] = elite
                solutions.sort(key=Packing.score)
    best = min((s[0] for s in islands), key=Packing.score)
    return list(best.bins.values())


def pack_shard(room: int, epoch: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.sort_values(
            ["length", "id", "row_check", "piece"], ignore_index=True, na_position="first"
        )
        lengths = rows["length"].to_numpy()
        sequence = np.full(len(rows), -1, dtype=np.int64)
        offset = np.zeros(len(rows), dtype=np.int64)
        settled = np.ones(len(rows), dtype=bool)
        whole = np.flatnonzero(lengths >= room)
        sequence[whole] = np.arange(len(whole))
        parts = np.flatnonzero(lengths < room)
        sizes = lengths[parts].tolist()
        for number, items in enumerate(evolve(sizes, room, seed=shard + 1)) if sizes else ():
            at = 0
            for item in items:
                sequence[parts[item]] = len(whole) + number
                offset[parts[item]] = at
                at += sizes[item]
            settled[parts[items]] = last or at >= NEARLY_FULL * room
        out = rows.drop(columns="shard")
        # Epoch, shard and bin: one number for each sequence.
        return out.assign(
            sequence_id=(((epoch << 31) + shard) << 30) + sequence, offset=offset, settled=settled
        )

    return pack


def best_fit_packing(pieces: DataFrame, room: int = 1024, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Sequences of at most ``room`` tokens from ``pieces`` (columns ``PIECES``).

    Returns the pieces with ``sequence_id`` and ``offset``, the place in the sequence; a
    sequence has no gaps.  A piece of ``room`` tokens is a sequence of its own; longer ones
    are refused.  Equal pieces are packed each.  No pieces give no rows.
    """
    names = ["id", "row_check", "piece", "start", "length", "ids_crc32"]

    def epoch(rows: DataFrame, number: int, last: bool) -> DataFrame:
        shards = max(1, -(-rows.count() // shard_pieces))
        shard = F.pmod(F.xxhash64(F.lit(number), "id", "row_check", "piece", "start"), F.lit(shards))
        return (
            rows.select(*names, shard.alias("shard"))
            .groupBy("shard")
            .applyInPandas(pack_shard(room, number, last), PACKED)
        )

    first = written(epoch(pieces, 0, False), "packed")
    second = epoch(first.where("NOT settled"), 1, True)
    return first.where("settled").union(second).drop("settled")


def cut_rows(path: str, end: int, room: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, True)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy()
            for together in anchors.batches(sizes, TOGETHER):
                part = batch.slice(together.start, together.stop - together.start)
                ids, lengths = tokens.encode_spaced(part.column("text"))
                ends = np.cumsum(lengths)
                data = np.insert(ids, ends, end).astype("<u4").tobytes()
                rows: list[tuple] = []
                first = 0
                for row, n in enumerate((lengths + 1).tolist()):
                    cuts = [0, *range(n % room or room, n + 1, room)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        crc = zlib.crc32(data[4 * (first + a) : 4 * (first + b)])
                        rows.append((row, piece, a, b - a, crc))
                    first += n
                row, piece, start, length, crc = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(row, pa.int64())),
                        part.column("row_check").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["id", "row_check", "piece", "start", "length", "ids_crc32"],
                )
                release_unused()

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    room: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every text's ids and ``end``, cut if they are more than ``room``.

    All pieces but the first have ``room`` ids.  A null text is empty: one piece, ``end``.
    Rows of one id are told apart by ``row_check``, a hash of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("row_check"), text.alias("text")
    ).mapInArrow(cut_rows(tokenizer, end, room), PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, room: int = 1024) -> DataFrame:
    pieces = written(token_pieces(docs, tokenizer, end, room), "pieces")
    return best_fit_packing(pieces, room).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
