"""Set similarity join on word shingles, filtered by prefixes under several token orders.

A document is the set of its distinct shingles, as 64-bit hashes.  Documents of one set
are one *class*; all below is about classes, so copies cost nothing.

If the similarity of sets of n and m tokens reaches t, then under any order of all
tokens their prefixes, the first ``n - ceil(t n) + 1`` tokens, have one in common.  How
many they must have in common follows from the sizes: the overlap has to reach
``ceil(t / (1 + t) (n + m))``, and behind the prefix there are only ``ceil(t n) - 1``.

1. **First order.**  Tokens are ordered by a scrambled hash, those that a sample of
   documents shows to be frequent last (a bitmap of fixed size; any order is right, and
   rare tokens first make short lists).  The prefixes are dealt by token, once, and each
   task reads its tokens in order: at most ``LIST`` holders become pairs, unless their
   sizes forbid it, and those of a longer list are tied to the least of them only: never
   all pairs.  Tokens known to be frequent are counted before they are dealt, so that
   none of them has all its holders in one task.  Pairs that share too few tokens go.
2. **Second order.**  A pair stays only if it shares enough prefix tokens under another
   order as well.  A document's row holds 16-bit marks of that order's prefix, and a bitmap
   keeps those of classes without a pair out of the shuffle.  No set has been moved up to here.
3. **Groups.**  Pairs and ties are joined to connected groups.  Two similar classes are
   always in one group, and each group's sets are fetched once; a bitmap of their
   documents keeps the texts of all others out of that shuffle.
   From each class in turn, the classes not reached yet that share enough prefix tokens
   under *every* one of three orders are the candidates; their whole sets are intersected,
   and those that are similar are reached next.  A class is compared with unreached ones
   only, so the links inside a component already found are never listed.
4. A group of more than ``GROUP_TOKENS`` tokens is divided into blocks, and each two
   blocks are compared as a group of their own: bounded memory, no pair lost.  Its
   components are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm import anchors
from lakehaul.llm.components import components
from lakehaul.llm.repeats import PASS_SYMBOLS, text_bytes, words_by_row
from lakehaul.llm.shared import giving_back, keyed_texts, rows_of_keys, written

#: Holders of a token that are paired with one another.
LIST = 256
#: Tokens of the sets that one task compares.
GROUP_TOKENS = 2_000_000
#: Of the documents, one in so many is looked at to order the tokens.
SAMPLE = 16
#: Bits of the bitmap of frequent tokens, as a power of two, and tokens put in it at most.
BITMAP_BITS, BITMAP_TOKENS = 22, 1 << 20
#: Bits of the bitmap of documents or classes that are wanted, as a power of two.
KEY_BITS = 25
#: Bits of a token by which pairs are compared under the second order, at most 16.
MARK_BITS = 16
#: Seeds of the token orders.
ORDERS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD1B54A32D192ED03)

SETS = (
    "key struct<id:bigint,check:bigint>, n int, class bigint, "
    "rare array<bigint>, often array<bigint>, marks array<smallint>, lost int"
)
SHARES = "u bigint, v bigint, u_n bigint, v_n bigint, shared bigint"
#: Prefix tokens that one numpy pass looks at.
PASS_TOKENS = 1 << 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of texts laid end to end."""
    data = LOWER[data]
    starts, ends, counts = words_by_row(data, lengths)
    words = anchors.stretch_hashes(anchors.prefix_sums(anchors.BYTE_CODES[data]), starts, ends)
    sums = anchors.prefix_sums(words)
    grams = anchors.gram_hashes(sums, size)
    stops = np.cumsum(counts)
    out = []
    for stop, count in zip(stops.tolist(), counts.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(grams[stop - count : stop - size + 1]))
        elif count:
            out.append(anchors.stretch_hashes(sums, np.array([stop - count]), np.array([stop])))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def text_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, places = text_bytes(column)
    lengths = np.diff(places)
    for part in anchors.batches(lengths, PASS_SYMBOLS):
        yield from shingle_sets(data[places[part.start] : places[part.stop]], lengths[part], size)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens sets of these sizes share if they are similar."""
    return -(-percent * (n + m) // (100 + percent))


def beyond(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of a set lie behind its prefix."""
    return -(-percent * n // 100) - 1


def frequent(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = (tokens >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1


def ranked(tokens: np.ndarray, seed: int, bitmap: np.ndarray | None) -> np.ndarray:
    """Sort keys of tokens: frequent ones last, otherwise scrambled by the seed."""
    rank = anchors.mix(tokens ^ np.uint64(seed)) >> np.uint64(1)
    if bitmap is not None:
        rank |= frequent(tokens, bitmap).astype(np.uint64) << np.uint64(63)
    return rank


def prefix_of(tokens: np.ndarray, seed: int, bitmap: np.ndarray | None, percent: int) -> np.ndarray:
    if not len(tokens):
        return tokens
    size = len(tokens) - int(beyond(np.int64(len(tokens)), percent))
    if size >= len(tokens):
        return tokens
    return tokens[np.argpartition(ranked(tokens, seed, bitmap), size)[:size]]


def class_of(tokens: np.ndarray) -> int:
    """One number per set, whatever the order of its tokens."""
    total = np.add.reduce(anchors.mix(tokens + np.uint64(0xA5A5A5A5)), dtype=np.uint64)
    return int(anchors.mix(np.array([total + np.uint64(len(tokens))])).view(np.int64)[0])


def marks_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The sorted distinct short marks of tokens."""
    return np.unique(anchors.mix(tokens) >> np.uint64(64 - bits)).astype(np.uint16)


def lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(kind) if arrays else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def make_sets(size: int, percent: int, bitmap: bytes, mark_bits: int) -> Callable:
    """Size, class and prefixes of each text, of the second one only marks.  A task gives a
    class's prefixes once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        none = np.empty(0, np.uint64)
        seen = set()
        for batch in batches:
            sizes, classes, lost, found = [], [], [], ([], [], [])
            for tokens in text_sets(batch.column("text"), size):
                sizes.append(len(tokens))
                classes.append(class_of(tokens) if len(tokens) else None)
                rare = often = second = none
                marks = none.astype(np.uint16)
                if len(tokens) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    first = prefix_of(tokens, ORDERS[0], bits, percent)
                    common = frequent(first, bits).astype(bool)
                    rare, often = first[~common], first[common]
                    second = prefix_of(tokens, ORDERS[1], bits, percent)
                    marks = marks_of(second, mark_bits)
                lost.append(len(second) - len(marks))
                for column, part in zip(found, (rare, often, marks), strict=True):
                    column.append(part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(sizes, pa.int32()),
                    pa.array(classes, pa.int64()),
                    lists(found[0]),
                    lists(found[1]),
                    lists(found[2], np.int16),
                    pa.array(lost, pa.int32()),
                ],
                ["key", "n", "class", "rare", "often", "marks", "lost"],
            )

    return giving_back(make)


def token_rows(size: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lists(list(text_sets(batch.column("text"), size))).flatten()
            yield pa.RecordBatch.from_arrays([column], ["token"])

    return giving_back(rows)


def list_pairs(classes: np.ndarray, sizes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, percent: int) -> Iterator[tuple]:
    """Pairs of the holders of one token whose sizes are near enough, for short lists."""
    for length in np.unique(lengths[lengths > 1]).tolist():
        low, high = np.triu_indices(length, 1)
        at = begins[lengths == length]
        step = max(1, PASS_TOKENS // len(low))
        for start in range(0, len(at), step):
            u = (at[start : start + step, None] + low).ravel()
            v = (at[start : start + step, None] + high).ravel()
            near = np.minimum(sizes[u], sizes[v]) * 100 >= np.maximum(sizes[u], sizes[v]) * percent
            u, v = u[near], v[near]
            yield classes[u], classes[v], sizes[u], sizes[v], np.ones(len(u), np.int64)


def share_rows(percent: int, most: int) -> Callable:
    """Pairs and ties of rows that come ordered by token and class.

    A tie has ``shared`` 0 and leads to the least holder, which is also tied to itself.
    Of a token whose list goes on, only up to ``most`` holders are kept in memory.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        empty = np.empty(0, np.int64)
        tokens, classes, sizes = empty, empty, empty
        long = None  # token and least holder of a long list that goes on
        waiting, rows, last = [], 0, False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "class", "n")])
                rows += batch.num_rows
                if rows < PASS_TOKENS:
                    continue
            columns = [(tokens, classes, sizes), *waiting]
            tokens, classes, sizes = (np.concatenate([c[i] for c in columns]).astype(np.int64) for i in range(3))
            waiting, rows = [], 0
            if not len(tokens):
                continue
            fresh = np.ones(len(tokens), dtype=bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
            tokens, classes, sizes = tokens[fresh], classes[fresh], sizes[fresh]
            begins = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            lengths = np.diff(np.append(begins, len(tokens)))
            least = classes[begins]
            tied = lengths > most
            if long is not None and tokens[0] == long[0]:
                least[0], tied[0] = long[1], True
            done = np.ones(len(begins), dtype=bool)
            done[-1] = last or tied[-1]
            use = ~tied & done
            yield from list_pairs(classes, sizes, begins[use], lengths[use], percent)
            each = np.repeat(tied, lengths)
            n, to = sizes[each], np.repeat(least[tied], lengths[tied])
            yield classes[each], to, n, n, np.zeros(len(n), np.int64)
            long = (tokens[-1], least[-1]) if tied[-1] else None
            rest = slice(len(tokens), None) if done[-1] else slice(int(begins[-1]), None)
            tokens, classes, sizes = tokens[rest], classes[rest], sizes[rest]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in scan(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "u_n", "v_n", "shared"])

    return giving_back(share)


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of 2^``bits`` bits, with those set that the column ``hash`` begins with."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    parts = (
        hashes.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(32767).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )  # 2^(bits - 15) rows of 4 KB at most
    bitmap = bytearray(1 << (bits - 3))
    for row in parts:
        bitmap[row["part"] * 4096 : row["part"] * 4096 + 4096] = bytes(row["bits"]).ljust(4096, b"\0")
    return bytes(bitmap)


def with_wanted_keys(rows: DataFrame, wanted: DataFrame, column: str = "key") -> DataFrame:
    """The ``rows`` whose ``column`` is among those of ``wanted``, and a few others: what a bitmap
    lets through, so that the others are not shuffled."""
    hashed = F.xxhash64(column).alias("hash")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(hashed), KEY_BITS))

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        place = (hashes.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
        bitmap = np.frombuffer(shared.value, np.uint8)
        return pd.Series((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)

    return rows.where(held(hashed))


def frequent_tokens(texts: DataFrame, size: int) -> bytes:
    """A bitmap, of fixed size, of tokens found three times or more in a sample."""
    counts = (
        texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)
        .mapInArrow(token_rows(size), "token bigint")
        .groupBy("token")
        .count()
        .where("count > 2")
    )
    counts = written(counts, "frequent")
    # The least count with which the tokens fit: their histogram has few rows.
    least, total = 3, 0
    for row in counts.groupBy(F.least("count", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        total += row["k"]
        if total > BITMAP_TOKENS:
            least = row["n"] + 1
            break
    return bitmap_of(counts.where(F.col("count") >= least).select(F.col("token").alias("hash")), BITMAP_BITS)


def reach(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component of every set: the least index it is linked with, over any way."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    component = np.full(count, -1, dtype=np.int64)
    lists = []
    owners = np.repeat(np.arange(count), sizes)
    tokens = np.concatenate(sets)
    for seed in ORDERS:
        prefixes = [prefix_of(s, seed, None, percent) for s in sets]
        names, place = np.unique(np.concatenate(prefixes), return_inverse=True)
        holder = np.repeat(np.arange(count), [len(p) for p in prefixes])
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(names) + 1))
        own = np.split(place, np.cumsum([len(p) for p in prefixes])[:-1])
        lists.append((own, starts, holder[order]))
    starts = np.cumsum(sizes) - sizes
    behind = beyond(sizes, percent)
    for root in range(count):
        if component[root] >= 0:
            continue
        component[root] = root
        front = [root]
        while front:
            x = front.pop()
            need = least_overlap(sizes, sizes[x], percent)
            open_ = (component < 0) & (need <= np.minimum(sizes, sizes[x]))
            for own, begin, holder in lists:
                if not open_.any():
                    break
                mine = own[x]
                shared = np.bincount(
                    np.concatenate([holder[begin[t] : begin[t + 1]] for t in mine.tolist()]),
                    minlength=count,
                )
                open_ &= shared >= np.maximum(need - np.maximum(behind, behind[x]), 1)
            near = np.flatnonzero(open_)
            if not len(near):
                continue
            at = np.repeat(starts[near] - np.append(0, np.cumsum(sizes[near])[:-1]), sizes[near])
            picked = tokens[at + np.arange(len(at))]
            spot = np.minimum(np.searchsorted(sets[x], picked), sizes[x] - 1)
            both = np.bincount(owners[at + np.arange(len(at))][sets[x][spot] == picked], minlength=count)
            linked = near[both[near] >= need[near]]
            component[linked] = root
            front.extend(linked.tolist())
    return component


def compare_group(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("class").sort_values("class", ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in rows["tokens"]]
        names = rows["class"].to_numpy()
        return pd.DataFrame({"u": names, "v": names[reach(sets, percent)]})

    return compare


def fetch_sets(size: int) -> Callable:
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            # Equal rows have one key: a task sends their set once.
            fresh = [c for c in enumerate(batch.column("class").to_pylist()) if c[1] not in seen and not seen.add(c[1])]
            batch = batch.take(pa.array([row for row, _ in fresh], pa.int64()))
            sets = [s.tobytes() for s in text_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("group"), batch.column("blocks"), pa.array(sets, pa.binary())],
                ["class", "group", "blocks", "tokens"],
            )

    return giving_back(fetch)


def often_shares(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs and ties of the tokens known to be frequent, counted before they are dealt."""
    tokens = sets.select(F.explode("often").alias("token"), "class", F.col("n").cast("bigint").alias("n"))
    shared = (
        tokens.groupBy("token", "class").agg(F.max("n").alias("n"))
        .groupBy("token")
        .agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("holders"))
        .where("holders > 1")
        .select("token", "least", (F.col("holders") > LIST).alias("long"))
    )
    holders = written(tokens.join(shared, "token").distinct(), "holders")
    ties = holders.where("long").select(
        F.col("class").alias("u"), F.col("least").alias("v"), F.col("n").alias("u_n"), F.col("n").alias("v_n"), F.lit(0).cast("bigint").alias("shared")
    )
    short = holders.where("NOT long").select("token", "class", "n")
    a, b = short.alias("a"), short.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class"))).where(
        F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    )
    return ties.union(
        pairs.select("a.class", "b.class", "a.n", "b.n", F.lit(1).cast("bigint"))
    )


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``u``, ``v``: pairs that pass both orders, and ties of long lists."""
    rare = (
        sets.select(F.explode("rare").alias("token"), "class", "n")
        .repartition("token")
        .sortWithinPartitions("token", "class")
        .mapInArrow(share_rows(percent, LIST), SHARES)
    )
    shares = written(
        rare.union(often_shares(sets, percent))
        .groupBy("u", "v")
        .agg(
            F.max("u_n").alias("u_n"),
            F.max("v_n").alias("v_n"),
            F.sum("shared").alias("shared"),
            F.count_if(F.col("shared") == 0).alias("ties"),
        ),
        "shares",
    )
    ties = shares.where("ties > 0")
    longs = ties.groupBy(F.col("u").alias("class")).agg(F.sum("ties").alias("longs"))
    high = F.greatest("u_n", "v_n")
    least = F.ceil((F.col("u_n") + F.col("v_n")) * percent / (100 + percent)) - F.ceil(high * percent / 100) + 1
    first = written(
        shares.where("shared > 0")
        .join(longs.select(F.col("class").alias("u"), F.col("longs").alias("u_longs")), "u", "left")
        .join(longs.select(F.col("class").alias("v"), F.col("longs").alias("v_longs")), "v", "left")
        .where(F.col("shared") + F.least(F.coalesce("u_longs", F.lit(0)), F.coalesce("v_longs", F.lit(0))) >= least)
        .select("u", "v", F.greatest(least, F.lit(1)).alias("least")),
        "first",
    )
    nodes = written(first.select(F.explode(F.array("u", "v")).alias("class")).distinct(), "nodes")
    # Pairs carry short marks of their tokens. Tokens of a set that have one mark are one less
    # in the count, and so many are added to it: no pair is lost.
    second = (
        with_wanted_keys(sets.where(F.size("marks") > 0), nodes, "class")
        .select("class", F.struct("marks", "lost").alias("second"))
        .join(nodes, "class", "left_semi")
        .groupBy("class")
        .agg(F.first("second").alias("second"))
    )
    second = written(second, "second")
    both = (
        first.join(second.select(F.col("class").alias("u"), F.col("second").alias("u_second")), "u")
        .join(second.select(F.col("class").alias("v"), F.col("second").alias("v_second")), "v")
        .where(
            F.size(F.array_intersect("u_second.marks", "v_second.marks")) + F.least("u_second.lost", "v_second.lost")
            >= F.col("least")
        )
    )
    return both.select("u", "v").union(ties.select("u", "v"))


def ngram_join(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of
    ``percent`` / 100 or more.

    Returns a row per row of ``docs``: the id, ``check`` (hash of the text, which tells
    rows with one id apart), ``n_shingles``, ``component`` (a number, null without shingles)
    and ``component_id``, the smallest id in the component.  Only A-Z are lower-cased; words lie between spaces and the codes 9 to
    13.  A text of fewer than ``size`` words is one shingle.  Null texts and texts without
    words have no shingle and are alone.  Rows without an id join components but never
    name them, unless no row in the component has an id.  Other columns are not looked
    at.  An empty table gives no rows.
    """
    texts = keyed_texts(docs, id_col, text_col)
    bitmap = frequent_tokens(texts, size)
    sets = written(texts.mapInArrow(make_sets(size, percent, bitmap, MARK_BITS), SETS), "sets")
    groups = components(candidates(sets, percent)).select(
        F.col("node").alias("class"), F.col("component").alias("group")
    )

    ones = sets.where("n > 0").groupBy("class").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    members = ones.join(groups, "class")
    blocks = members.groupBy("group").agg(
        F.ceil(F.sum("n") / F.lit(group_tokens / 2)).cast("int").alias("blocks")
    )
    wanted = written(
        members.join(blocks, "group").select("key", "class", "group", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1).alias("blocks")), "members"
    )
    found = (
        with_wanted_keys(texts, wanted)
        .join(wanted, "key")
        .select("text", "class", "group", "blocks")
        .mapInArrow(fetch_sets(size), "class bigint, group bigint, blocks int, tokens binary")
    )
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pairing = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(other, "block").alias("low"), F.greatest(other, "block").alias("high")),
    )
    links = (
        found.withColumn("block", block)
        .withColumn("pair", F.explode(pairing))
        .groupBy("group", "pair")
        .applyInPandas(compare_group(percent), "u bigint, v bigint")
    )
    linked = components(links).select(
        F.col("node").alias("class"), F.col("component")
    )
    named = (
        sets.where("n > 0").groupBy("class").agg(F.min("key.id").alias("id"))
        .join(linked, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    names = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = named.join(names, "component").select("class", "component", "component_id")
    return sets.join(classes, "class", "left").select(
        F.col("key.id").alias(id_col),
        F.col("key.check").alias("check"),
        F.col("n").cast("bigint").alias("n_shingles"),
        "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key.id")).alias("component_id"),
    )


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_shingles", "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: the row of the smallest id of each component stays.

    Rows without shingles all stay, equal ones as one row.
    """
    found = ngram_join(docs, id_col=id_col, text_col=text_col)
    key = F.struct(F.col(id_col).alias("id"), "check")
    first = F.min(F.struct(F.col(id_col).isNull().alias("last"), key.alias("key")))
    alone = found.where("component IS NULL").select(key.alias("key"))
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first.alias("first"))
    keys = kept.select("first.key").union(alone).distinct()
    return rows_of_keys(docs, written(keys, "kept"), id_col, text_col)
