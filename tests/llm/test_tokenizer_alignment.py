"""Alignment against a plain scan over token spans, by another encoder of the same vocabulary."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from lakehaul.llm.tokenizer_alignment import (
    align_tokenizers,
    irregular_groups,
    op12_tokenizer_alignment,
    overlaps,
)
from tests.conftest import DATA

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encoders():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    a = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def spans(ids, parts):
    out, at = [], 0
    for i, part in zip(ids, parts, strict=True):
        out.append((i, at, at + len(part)))
        at += len(part)
    return out


def brute(rows, encoders):
    first, second = encoders
    documents = []
    for i, text in rows:
        a = first.encode_ordinary(" " + text) if text else []
        b = second.encode(text) if text else []
        a_parts = [first.decode_single_token_bytes(x) for x in a]
        pieces = [second.id_to_piece(x) for x in b]
        b_parts = [
            bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces)
        ]
        if not text or b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
            documents.append((i, [], []))
        else:
            documents.append((i, spans(a, a_parts), spans(b, b_parts)))
    links = [
        [(x, y) for x, s, t in a for y, u, v in b if s < v and u < t] for _, a, b in documents
    ]
    count = Counter(pair for held in links for pair in set(held))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, a, b), held in zip(documents, links, strict=True):
        cuts = sorted({t for *_, t in a} & {t for *_, t in b})
        groups = [
            ",".join(str(x) for x, _, t in a if low < t <= cut) + "|" + ",".join(str(y) for y, _, t in b if low < t <= cut)
            for low, cut in zip([0, *cuts], cuts)
        ]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(count[p] == best[p[0]] for p in held)
        out.append((i, len(a), len(b), len(cuts), len(held), n_best, sum(count[p] for p in held), digest))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


TEXTS = [
    None, "", " ", "  ", "a", " x", "x ", "a  b", "a\nb", "\n\n a\tb", "a b c", "a▁b", "▁", "<|endoftext|> a", "<s> </s> <unk>",
    "<0x0A>", "é\xa0日本語   z", "x" * 3000, "a " * 800, "\x00\x01 b", "\x1c a\x1cb", "it's 's 'll 100km", "ﬁ ǆ 👍🏽 👍",
    "Straßenbahn fährt", "the the the", "a b c", "\u3000wide\u3000", "tab\t\tend", "e\u0301 combining", "0123456789 " * 20,
]


@pytest.mark.parametrize("part_bytes", [3 << 20, 30])
def test_odd_texts(spark, encoders, part_bytes):
    rows = [*enumerate(TEXTS), (None, "a b"), (None, "a b"), (4, "other text"), (4, "a")]
    docs = spark.createDataFrame(
        [(i, t, "p", True, 1) for i, t in rows], "doc_id bigint, text string, part string, is_part boolean, pairs int"
    ).repartition(4)
    assert found(align_tokenizers(docs, BYTE, PIECE, part_bytes=part_bytes)) == brute(rows, encoders)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(align_tokenizers(docs, BYTE, PIECE)) == []


def test_query(spark, encoders):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in docs if r.text is None or len(r.text) < 1500]
    whole = {r[0]: r for r in found(op12_tokenizer_alignment(spark, DATA))}
    assert len(whole) == len(docs)
    # What one document tells alone; counts of the corpus are compared below.
    for want in brute(short, encoders):
        assert whole[want[0]][:5] == want[:5] and whole[want[0]][7] == want[7]
    table = spark.createDataFrame(short, "doc_id bigint, text string").repartition(3)
    assert found(align_tokenizers(table, BYTE, PIECE, part_bytes=2000)) == brute(short, encoders)


@pytest.mark.parametrize("seed", range(30))
def test_runs_and_groups(seed):
    """Random cuts of one stretch of bytes, with long one-to-one stretches between."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    shared = rng.random(n) < rng.choice([0.1, 0.5, 0.95])
    a, b = ((shared | (rng.random(n) < rng.choice([0.0, 0.05, 0.5]))).nonzero()[0] + 1 for _ in range(2))
    a, b = np.union1d(a, [n]), np.union1d(b, [n])
    cuts = np.intersect1d(a, b)
    i, j = np.searchsorted(a, cuts) + 1, np.searchsorted(b, cuts) + 1
    groups = zip(np.append(0, i[:-1]).tolist(), i.tolist(), np.append(0, j[:-1]).tolist(), j.tolist())
    want = [g for g in groups if (g[1] - g[0], g[3] - g[2]) != (1, 1)]
    assert irregular_groups(a, b) == want
    one, two = overlaps(a, b, want)
    starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    every = {(x, y) for x in range(len(a)) for y in range(len(b)) if starts_a[x] < b[y] and starts_b[y] < a[x]}
    assert {*zip(one.tolist(), two.tolist())} == every and len(one) == len(every)
