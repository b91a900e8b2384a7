"""Candidates of the n-gram join, and hashes that crafted texts cannot make equal."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from lakehaul.llm import anchors, ngram_join
from lakehaul.llm.substring_dedup import substring_dedup
from lakehaul.llm.suffix_dedup import suffix_dedup


def mirrored(n: int, a: str, b: str, join: str = "") -> list[str]:
    """Two texts whose polynomial hashes modulo 2**64 are equal under every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [join.join((a, b)[bit] for bit in bits), join.join((b, a)[bit] for bit in bits)]


def linked(sets: dict) -> dict:
    names = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                names[a] = names[b] = min(names[a], names[b])
    return names


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_products_and_sums_modulo_the_prime():
    rng = np.random.default_rng(3)
    p = anchors.PRIME
    a = np.append(rng.integers(0, p, 9000, dtype=np.uint64), [0, 1, p - 1, p - 1]).astype(np.uint64)
    b = np.append(rng.integers(0, p, 9000, dtype=np.uint64), [p - 1, p - 1, 1, p - 1]).astype(np.uint64)
    assert anchors.times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    edges = np.array([0, p - 1, p, p + 1, 2 * p, (1 << 64) - 1], dtype=np.uint64)
    assert anchors.reduced(edges).tolist() == [x % p for x in edges.tolist()]
    symbols = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    base, inverse = anchors.powers(500)
    assert set(anchors.times(base, inverse).tolist()) == {1}
    total, sums = 0, [0]
    for symbol, power in zip(symbols.tolist(), base.tolist(), strict=True):
        total = (total + symbol * power) % p
        sums.append(total)
    assert anchors.prefix_sums(symbols).tolist() == sums


@pytest.mark.parametrize("block", [1 << 17, 40, 7])
@pytest.mark.parametrize("most", [1, 3, 256])
def test_pairs_and_ties_of_lists_in_any_batches(monkeypatch, block, most):
    monkeypatch.setattr(ngram_join, "PASS_TOKENS", block)
    rng = np.random.default_rng(most)
    n = {c: int(rng.integers(80, 120)) for c in range(-20, 20)}
    rows = sorted((int(t * t / 30), int(c)) for t, c in zip(rng.integers(0, 30, 300), rng.integers(-20, 20, 300), strict=True))
    columns = [[t for t, _ in rows], [c for _, c in rows], [n[c] for _, c in rows]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 9]) for c in columns], ["token", "class", "n"]) for i in range(0, 300, 9)]
    found = [r for b in ngram_join.share_rows(80, most)(iter(batches)) for r in b.to_pylist()]
    pairs, ties = [], set()
    for _, group in itertools.groupby(sorted(set(rows)), key=lambda r: r[0]):
        held = [c for _, c in group]
        if len(held) > most:
            ties |= {(c, held[0]) for c in held}
        else:
            pairs += [(a, b) for a, b in itertools.combinations(held, 2) if min(n[a], n[b]) * 100 >= max(n[a], n[b]) * 80]
    assert sorted((r["u"], r["v"]) for r in found if r["shared"]) == sorted(pairs)
    assert {(r["u"], r["v"]) for r in found if not r["shared"]} == ties
    assert all((r["u_n"], r["v_n"]) == (n[r["u"]], n[r["v"]]) for r in found if r["shared"])


@pytest.mark.parametrize("most", [256, 2])
def test_links_of_many_near_texts(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "LIST", most)
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(300)]
    line = " ".join(rng.choice(vocabulary, 12))
    texts = []
    for _ in range(12):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 90))))
        for _ in range(int(rng.integers(1, 7))):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 4))):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy) + (f" {line}" if rng.random() < 0.5 else ""))
    texts += [line] * 3 + ["a b c", "a b c", "a b d", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    # Repeated rows, and rows without an id, change no name.
    more = [rows[0], rows[0], (None, texts[1]), (None, "alone without an id in words")]
    docs = spark.createDataFrame([*rows, *more], "doc_id bigint, text string").repartition(4)
    found = ngram_join.ngram_join(docs).collect()
    assert len(found) == len(rows) + len(more)
    want = linked({i: shingles(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert sorted(r.component_id is None for r in found if r.doc_id is None) == [False, True]


def test_mirrored_texts_are_different(spark):
    words = mirrored(2048, "a", "b")
    lines = mirrored(2048, "ab", "ba", " ")
    docs = spark.createDataFrame(list(enumerate([*words, *lines])), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs.where("doc_id < 2")).collect()} == {0: 0, 1: 1}
    for texts in (words, lines):
        hashes = set()
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            hashes.add(int(anchors.stretch_hashes(anchors.prefix_sums(anchors.BYTE_CODES[data]), np.array([0]), np.array([len(data)]))[0]))
        assert len(hashes) == 2
    # Only the whole texts are as long as the window, and they differ.
    rows = substring_dedup(docs.where("doc_id > 1"), width=2048).collect()
    assert sorted((r.doc_id, r.kept) for r in rows) == [(2, lines[0]), (3, lines[1])]
    rows = suffix_dedup(docs.where("doc_id < 2"), width=2048).collect()
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in rows) == [(0, words[0]), (1, words[1])]


def test_texts_of_no_group_are_not_fetched(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(3000)], "doc_id bigint, text string")
    texts = ngram_join.keyed_texts(docs, "doc_id", "text")
    found = {r.key.id for r in ngram_join.with_wanted_keys(texts, texts.where("key.id % 100 = 0")).collect()}
    assert found >= set(range(0, 3000, 100)) and len(found) < 60


@pytest.mark.parametrize("bit", [b"\0", b"\xff", b"\x5a"])
def test_components_are_the_same_whatever_tokens_are_taken_for_frequent(spark, monkeypatch, bit):
    """The sample orders tokens; counts and links are those of whole sets."""
    monkeypatch.setattr(ngram_join, "frequent_tokens", lambda texts, size: bit * (1 << (ngram_join.BITMAP_BITS - 3)))
    rng = np.random.default_rng(9)
    rows = []
    for i in range(12):
        words = [f"v{w}" for w in rng.integers(0, 50, 60)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-2], "x"])), (3 * i + 2, " ".join(words[:40]))]
    want = linked({i: shingles(text) for i, text in rows})
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(text)) for i, text in rows}


@pytest.mark.parametrize("bits", [16, 3])
def test_marks_of_tokens_lose_no_pair(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "MARK_BITS", bits)
    rng = np.random.default_rng(bits)
    rows = []
    for i in range(12):
        words = [f"v{w}" for w in rng.integers(0, 900, 150)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-9], "x"])), (3 * i + 2, " ".join(words[20:]))]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == linked({i: shingles(text) for i, text in rows})


def test_marks_of_the_second_order_are_short_from_the_start():
    """A document's row holds two bytes a token of them, whatever is joined later."""
    text = " ".join(f"v{i}" for i in range(3000))
    key = pa.array([{"id": 1, "check": 1}])
    batch = pa.RecordBatch.from_arrays([key, pa.array([text])], ["key", "text"])
    make = ngram_join.make_sets(5, 80, bytes(1 << (ngram_join.BITMAP_BITS - 3)), 16)
    (out,) = make(iter([batch]))
    marks, lost = out.column("marks"), out.column("lost")[0].as_py()
    assert marks.type == pa.list_(pa.int16())
    n = out.column("n")[0].as_py()
    assert len(set(marks[0].as_py())) == len(marks[0]) == n - int(ngram_join.beyond(np.int64(n), 80)) - lost
    assert "second" not in out.schema.names


def test_marks_of_classes_without_a_pair_are_not_shuffled(spark, monkeypatch):
    asked = []
    keep = ngram_join.with_wanted_keys

    def spy(rows, wanted, column="key"):
        found = keep(rows, wanted, column)
        asked.append((column, rows.count(), found.count()))
        return found

    monkeypatch.setattr(ngram_join, "with_wanted_keys", spy)
    words = [[f"w{i}x{j}" for j in range(60)] for i in range(300)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(900, " ".join([*words[0][:-1], "other"]))]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found if r.component_id != r.doc_id} == {900}
    assert [n for column, n, _ in asked if column == "class"] == [301]
    assert all(kept < 20 for _, _, kept in asked)
