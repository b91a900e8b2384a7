"""Alignment of the tokens of two tokenizers, and how often their ids meet in a corpus.

Both tokenizers cut the same bytes.  With the end offsets of the tokens of either side in two
ascending arrays, a place where both have an end closes a group.

*Diagonal run skipping.*  Most groups hold one token of each side, and as long as they do, the
two arrays agree along a diagonal: the index shift between them stays the same.  So the arrays
are compared at the present shift, in stretches that double as long as they are equal and
halve when they are not; all of an equal stretch is skipped at once.  At the first place that
differs the group is irregular: it is resolved by advancing the side that is behind until both
ends meet, and the shift is changed by the difference of its sizes.

*Passes.*  The first reads the texts once: a task takes them in parts of ``PART_BYTES``, encodes
each distinct word of a part once, aligns the part, and writes a row per document with its
distinct id pairs and, beside them, a row per part with the part's distinct pairs and the
number of its documents that hold each.  The counts of the corpus are sums over the parts.  Each
part then gets the counts of its own pairs back, in one row, and the documents of a part
are finished with it.  What is shuffled is thus a row per pair and part, not per pair and
document, and the documents' pairs once; no group is larger than a part.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehaul.llm.shared import written

#: Text of one part; a longer text is a part of its own.
PART_BYTES = 3 << 20
#: Texts of one part, at most: so a text, an A id and a B id fit in 63 bits up to 24 bits an id.
PART_ROWS = 32_000
#: Words whose tokens a Python worker keeps.
CACHE_WORDS = 400_000
#: Words encoded as one string.
JOINED = 1024
#: Bits of an id in a pair.
ID_BITS = 31

ALIGNED = (
    "part bigint, is_part boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, "
    "n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
)
COUNTED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string"
)
_TOKENIZERS: dict[tuple[str, str], TwoTokenizers] = {}


# --- alignment ----------------------------------------------------------------


def irregular_groups(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Groups that are not one token to one: first and last + 1 token of either side.

    ``a`` and ``b`` are ascending end offsets of the same bytes.
    """
    a, b = np.ascontiguousarray(a, dtype=np.int64), np.ascontiguousarray(b, dtype=np.int64)
    # Stretches are compared as bytes, single ends as numbers; the last ones never agree.
    a_bytes, b_bytes = a.tobytes(), b.tobytes()
    a_ends, b_ends = [*a.tolist(), -1], [*b.tolist(), -2]
    n_a, n_b = len(a), len(b)
    found = []
    i = j = 0
    while True:
        x, y = a_ends[i], b_ends[j]
        if x == y:
            i, j, step, growing = i + 1, j + 1, 2, True
            while step:
                same = a_bytes[8 * i : 8 * (i + step)] == b_bytes[8 * j : 8 * (j + step)]
                if same and i + step <= n_a and j + step <= n_b:
                    i, j = i + step, j + step
                else:
                    growing = False
                step = 2 * step if growing else step >> 1
            x, y = a_ends[i], b_ends[j]
        if i == n_a or j == n_b:
            return found
        i_from, j_from = i, j
        while x != y:
            if x < y:
                i += 1
                x = a_ends[i]
            else:
                j += 1
                y = b_ends[j]
        i, j = i + 1, j + 1
        found.append((i_from, i, j_from, j))


def inside(irregular: list, first: int, n: int) -> np.ndarray:
    """Which of a side's n tokens are in an irregular group; ``first`` is the side's column."""
    change = np.zeros(n + 1, dtype=np.int8)
    if irregular:
        groups = np.array(irregular, dtype=np.int64)
        # Neighbouring groups share an edge: there one ends and one begins.
        change[groups[:, first]] += 1
        change[groups[:, first + 1]] -= 1
    return np.cumsum(change[:-1]) > 0


def overlaps(a: np.ndarray, b: np.ndarray, irregular: list) -> tuple[np.ndarray, np.ndarray]:
    """Token indices of every overlapping pair.

    A one-to-one group is one pair.  Inside the irregular groups every byte range between two
    neighbouring ends, of whichever side, is one.
    """
    in_a, in_b = inside(irregular, 0, len(a)), inside(irregular, 2, len(b))
    ends = np.sort(np.concatenate([a[in_a], b[in_b]]))
    ends = ends[np.diff(ends, prepend=-1) > 0]
    one = np.concatenate([np.flatnonzero(~in_a), np.searchsorted(a, ends)])
    two = np.concatenate([np.flatnonzero(~in_b), np.searchsorted(b, ends)])
    return one, two


# --- tokens of texts ----------------------------------------------------------


class TwoTokenizers:
    """Ids and byte lengths of texts under a byte-level BPE (A) and a piece model (B).

    A text is encoded by A with a space before it, which B adds itself.  Where no white space
    follows on other white space both sides encode the words, with the space before each, on
    their own: A never joins across a space before a letter, digit or sign, and B has no piece
    with a space behind its first sign.  Other texts are encoded whole.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = {v: k for k, v in byte_letters().items()}
        self.a_bytes = [b""] * (max(self.a.get_vocab(with_added_tokens=False).values()) + 1)
        for token, at in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in letters for c in token):
                self.a_bytes[at] = bytes(letters[c] for c in token)
        self.b_bytes = []
        for at in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(at)
            plain = piece.replace("▁", " ").encode()
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(at) else plain)
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.opens = np.array([x.startswith(b" ") for x in self.a_bytes])
        self.by_words = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))
        # Ids as text, of A with "," or "|" behind it, of B with ",", ";" or nothing.
        endings = [(len(self.a_bytes), ",|"), (len(self.b_bytes), (",", ";", ""))]
        self.decimals = pa.array(
            [f"{at}{sign}" for n, signs in endings for at in range(n) for sign in signs], pa.large_string()
        )
        # A word's ids as one string of 32-bit numbers: how many of A, those, those of B.
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _checked(self, text: str, a: list[int], b: list[int]) -> bytes | None:
        """Both sides' ids; ``None`` unless both spell a space and the text."""
        want = b" " + text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        return np.array([len(a), *a, *b], dtype="<i4").tobytes()

    def whole(self, text: str) -> bytes | None:
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return self._checked(text, a, self.b.encode(text))

    def _learn(self, words: list[str]) -> None:
        joined = " " + " ".join(words)
        a = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
        a_ids = np.array(a, dtype="<i4")
        begins = np.flatnonzero(self.opens[a_ids])
        split = self.b.encode(words, num_threads=1)
        b = list(itertools.chain.from_iterable(split))
        want = joined.encode()
        spelt = b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])
        if len(begins) != len(words) or not spelt:
            # Some word is not as expected: one by one.
            self.cache.update((w, self.whole(w)) for w in words)
            return
        a_data, b_data = a_ids.tobytes(), np.array(b, dtype="<i4").tobytes()
        a_ends = np.append(begins[1:], len(a_ids))
        heads = np.diff(a_ends, prepend=0).astype("<i4").tobytes()
        b_ends = (np.cumsum(np.fromiter(map(len, split), np.int64, len(split))) * 4).tolist()
        x = y = at = 0
        for word, x_to, y_to in zip(words, (a_ends * 4).tolist(), b_ends, strict=True):
            self.cache[word] = heads[at : at + 4] + a_data[x:x_to] + b_data[y:y_to]
            x, y, at = x_to, y_to, at + 4

    def words(self, words: list[str]) -> list[bytes | None]:
        """The ids of words without a space in them, from the cache where they are there."""
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > CACHE_WORDS // 2:
            # Half full, it becomes the older half, of which words that come again are kept.
            self.older, self.cache, missing = self.cache, {}, words
        again = {w: self.older[w] for w in missing if w in self.older}
        self.cache.update(again)
        missing = [w for w in missing if w not in again]
        for at in range(0, len(missing), JOINED):
            self._learn(missing[at : at + JOINED])
        return [self.cache[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, end to end, and their numbers per text; none for a text that
        is empty or that either side does not spell."""
        found: list[bytes | None] = [None] * len(texts)
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _BREAKS).to_pylist()
        plain = [at for at, t in enumerate(texts) if t and self.by_words and not odd[at]]
        for at in {*range(len(texts))}.difference(plain):
            found[at] = self.whole(texts[at]) if texts[at] else None
        split = pc.split_pattern(pa.array([texts[at] for at in plain], pa.large_string()), " ")
        numbered = pc.list_flatten(split).dictionary_encode()
        known = self.words(numbered.dictionary.to_pylist())
        good = np.array([k is not None for k in known], dtype=bool)
        number = numbered.indices.to_numpy()
        counts = pc.list_value_length(split).to_numpy()
        of_text = np.repeat(np.arange(len(plain)), counts)
        # One bad word makes its text one without tokens.
        bad = np.unique(of_text[~good[number]]) if len(number) else np.empty(0, dtype=np.int64)
        kept = ~np.isin(of_text, bad)
        pool = np.frombuffer(b"".join([k for k in known if k is not None]), dtype="<i4")
        sizes = np.fromiter((len(k) // 4 if k is not None else 0 for k in known), np.int64, len(known))
        starts = np.cumsum(sizes) - sizes
        of_a = np.zeros(len(known), dtype=np.int64)
        of_a[good] = pool[starts[good]]
        of_b = np.where(good, sizes - 1 - of_a, 0)
        chosen, owner = number[kept], of_text[kept]
        sides = []
        for side, (begin, sizes) in enumerate(((starts + 1, of_a), (starts + 1 + of_a, of_b))):
            each = sizes[chosen]
            total = np.bincount(owner, each, minlength=len(plain)).astype(np.int64)
            first = begin[chosen] - (np.cumsum(each) - each)
            places = np.repeat(first, each) + np.arange(int(each.sum()))
            sides.append(self._in_order(texts, plain, total, pool[places], found, side))
        (a, n_a), (b, n_b) = sides
        return a, b, n_a, n_b

    @staticmethod
    def _in_order(texts, plain, total, ids, found, side) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by words and of texts encoded whole, in the order of the texts."""
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[plain] = total
        whole = [at for at, f in enumerate(found) if f is not None]
        if not whole:
            return ids.astype(np.int64), lengths
        others = {}
        for at in whole:
            entry = np.frombuffer(found[at], dtype="<i4")
            others[at] = entry[1 + entry[0] :] if side else entry[1 : 1 + entry[0]]
        for at, part in others.items():
            lengths[at] = len(part)
        out = np.empty(int(lengths.sum()), dtype=np.int64)
        ends = np.cumsum(lengths)
        mask = np.ones(len(out), dtype=bool)
        for at, part in others.items():
            out[ends[at] - len(part) : ends[at]] = part
            mask[ends[at] - len(part) : ends[at]] = False
        out[mask] = ids
        return out, lengths


#: Where words are not independent: white space next to white space, or at either end.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_BREAKS = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z"


def byte_letters() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is printed
    and no space, otherwise the next free one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {b: chr(b) for b in printed} | {b: chr(256 + at) for at, b in enumerate(others)}


def two_tokenizers(byte_path: str, piece_path: str) -> TwoTokenizers:
    """One per worker process: its cache serves all tasks that the worker runs."""
    found = _TOKENIZERS.get((byte_path, piece_path))
    if found is None:
        found = _TOKENIZERS[byte_path, piece_path] = TwoTokenizers(byte_path, piece_path)
    return found


# --- parts --------------------------------------------------------------------


def group_bytes(both: TwoTokenizers, a, b, closes_a, closes_b, last_b) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;`` of every group, end to end, without the last sign of a document, and where
    each token's text begins, groups in order and A before B."""
    groups_a, groups_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    b_before = np.concatenate([[0], np.flatnonzero(closes_b) + 1])
    a_until = np.flatnonzero(closes_a) + 1
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + b_before[groups_a]] = 2 * a + closes_a
    codes[np.arange(len(b)) + a_until[groups_b]] = 2 * len(both.a_bytes) + 3 * b + closes_b + last_b
    texts = both.decimals.take(pa.array(codes))
    begins = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(codes) + 1]
    return (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), begins


def sums_per_row(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``flags``."""
    total = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def align_part(both: TwoTokenizers, part: int, ids: list, texts: list[str]) -> dict[str, list]:
    """The rows of one part: one per document and, last, the part's own."""
    a, b, n_a, n_b = both.encode(texts)
    # Documents end to end: each one's end is an end of both sides.
    ends_a, ends_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    irregular = irregular_groups(ends_a, ends_b)
    closes_a = (~inside(irregular, 0, len(a))).astype(np.int64)
    closes_a[[i_to - 1 for _, i_to, _, _ in irregular]] = 1
    closes_b = (~inside(irregular, 2, len(b))).astype(np.int64)
    closes_b[[j_to - 1 for _, _, _, j_to in irregular]] = 1
    n_groups = sums_per_row(closes_a, n_a)
    last_b = np.zeros(len(b), dtype=np.int64)
    last_b[np.cumsum(n_b)[n_b > 0] - 1] = 1
    data, begins = group_bytes(both, a, b, closes_a, closes_b, last_b)
    edges = begins[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist() if len(data) else [0] * (len(texts) + 1)
    hashes = [
        hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(edges, edges[1:])
    ]
    one, two = overlaps(ends_a, ends_b, irregular)
    doc = np.repeat(np.arange(len(texts)), n_a)[one]
    # Distinct pairs of each document: one sort by document and pair.
    a_bits, b_bits = (len(x).bit_length() for x in (both.a_bytes, both.b_bytes))
    keys = np.sort(((doc << a_bits | a[one]) << b_bits) | b[two])
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    doc = keys >> (a_bits + b_bits)
    pair = (keys >> b_bits & ((1 << a_bits) - 1)) << ID_BITS | keys & ((1 << b_bits) - 1)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    held = np.sort(pair)
    firsts = np.flatnonzero(np.diff(held, prepend=-1))
    of_part, documents = held[firsts], np.diff(np.append(firsts, len(held)))
    n = len(texts)
    return {
        "part": [part] * (n + 1),
        "is_part": [False] * n + [True],
        "doc_id": [*ids, None],
        "n_a": [*n_a.tolist(), 0],
        "n_b": [*n_b.tolist(), 0],
        "n_groups": [*n_groups.tolist(), 0],
        "n_links": [*(n_a + n_b - n_groups).tolist(), 0],
        "groups_sha256": [*hashes, ""],
        "pairs": [*(pair[x:y] for x, y in zip(edges, edges[1:])), of_part],
        "times": [*(times[x:y] for x, y in zip(edges, edges[1:])), documents],
    }


def align_batches(byte_path: str, piece_path: str, part_bytes: int) -> Callable:
    fields = [
        ("part", pa.int64()), ("is_part", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
        ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = align_part(both, number, ids, texts)
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema(fields))

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and (size + len(text) > part_bytes or len(texts) == PART_ROWS):
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(at)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return run


def with_counts(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Counts of a part's pairs added up over the links of each of its documents."""
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    lengths = docs["pairs"].map(len).to_numpy()
    pairs = np.concatenate([np.empty(0, np.int64), *docs["pairs"]]).astype(np.int64)
    times = np.concatenate([np.empty(0, np.int64), *docs["times"]]).astype(np.int64)
    if len(counts) and len(pairs):
        row = counts.iloc[0]
        known = np.asarray(row["pairs"], dtype=np.int64)
        order = np.argsort(known)
        at = order[np.searchsorted(known, pairs, sorter=order)]
        n, best = (np.asarray(row[c], dtype=np.int64)[at] for c in ("counts", "bests"))
    else:
        n = best = np.zeros(len(pairs), dtype=np.int64)
    out["n_best"] = sums_per_row(times * (n == best), lengths)
    out["count_sum"] = sums_per_row(times * n, lengths)
    return out


def align_tokenizers(
    docs: DataFrame,
    byte_tokenizer: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Alignment of every whole text under both tokenizers, one row per row of ``docs``.

    ``n_a`` and ``n_b`` count tokens, ``n_groups`` the groups between places where tokens of both
    sides end, ``n_links`` the pairs of tokens that overlap.  ``n_best`` are the links whose id
    pair is linked in as many documents as any pair of its A id, ``count_sum`` sums, over the
    links, the documents that hold the link's id pair.  ``groups_sha256`` is of all groups as
    ``a1,a2|b1;a3|b2``.  Strings of special tokens are plain text.

    A text that is null or empty, or whose tokens of either side do not spell a space and the
    text, has no tokens: zeros and an empty hash.  Rows with equal or null ids are documents of
    their own, and each counts.  An empty table gives no rows; other columns are not looked at.
    """
    aligned = written(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(align_batches(byte_tokenizer, piece_model, part_bytes), ALIGNED),
        "aligned",
    )
    held = aligned.where("is_part").select(
        "part", F.explode(F.arrays_zip("pairs", "times")).alias("p")
    ).select("part", F.col("p.pairs").alias("pair"), F.col("p.times").alias("documents"))
    counts = held.groupBy("pair").agg(F.sum("documents").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", ID_BITS))
    bests = counts.groupBy("a").agg(F.max("count").alias("best"))
    counts = written(counts.join(bests, "a").select("pair", "count", "best"), "pair-counts")
    of_parts = (
        held.join(counts, "pair")
        .groupBy("part")
        .agg(F.collect_list(F.struct("pair", "count", "best")).alias("c"))
        .select(F.col("part").alias("of_part"), F.col("c.pair").alias("pairs"), F.col("c.count").alias("counts"), F.col("c.best").alias("bests"))
    )
    return (
        aligned.where("NOT is_part")
        .groupBy("part")
        .cogroup(of_parts.groupBy("of_part"))
        .applyInPandas(with_counts, COUNTED)
    )


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
