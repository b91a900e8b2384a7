"""The operators against brute force on small tables with nulls, copies and ties."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakehaul.llm.exact_dedup import CuckooFilter, DigestIndex, exact_dedup
from lakehaul.llm.language_id import in_known_language, language_id
from lakehaul.llm.ngram_join import ngram_join
from lakehaul.llm.packing import best_fit_packing, token_pieces
from lakehaul.llm.pii import base_spans, find_pii
from lakehaul.llm.source_mix import source_mix
from lakehaul.llm.substring_dedup import substring_dedup
from lakehaul.llm.suffix_dedup import suffix_dedup
from lakehaul.llm.token_files import read_token_files, write_token_files
from lakehaul.llm.voronoi_knn import voronoi_knn

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER_WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER_BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int"
WORDS = [f"w{i}" for i in range(40)]


def texts() -> list[str | None]:
    rng = np.random.default_rng(7)
    plain = [" ".join(rng.choice(WORDS, n)) for n in (3, 8, 60, 120, 120)]
    passage = " ".join(rng.choice(WORDS, 20))
    near = plain[3].split()
    near[50] = "changed"
    return [
        None, "", " \t\n", "one", *plain, plain[3], plain[3], plain[2].replace(" ", "  \n"),
        " ".join(near), f"{plain[0]} {passage} x", f"{passage} y {plain[1]}", "ab " * 200,
        "Été naïve ß", "\x00\x01 b", "mail a.b@c.example.org, ip 10.0.0.255, +1 (743) 555-3824.",
        "4111 1111 1111 1111, not 999.1.1.1",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, "k", 1) for i, t in enumerate(texts())]
    rows += [(None, "one", None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def covered(sequences: list, width: int) -> list[list[bool]]:
    seen = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                flags[i : i + width] = [True] * width
        out.append(flags)
    return out


@pytest.mark.parametrize("most_contents", [4096, 0])
def test_suffix_dedup(docs, most_contents):
    given = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = sorted(
        (str(i), bytes(b for b, f in zip(t, flags, strict=True) if not f))
        for (i, t), flags in zip(given, covered([t for _, t in given], 40), strict=True)
    )
    rows = suffix_dedup(docs, width=40, most_contents=most_contents).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in rows) == want


@pytest.mark.parametrize("most_contents", [4096, 0])
def test_substring_dedup(docs, most_contents):
    given = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    want = sorted(
        (str(i), len(w), " ".join(x for x, f in zip(w, flags, strict=True) if not f))
        for (i, w), flags in zip(given, covered([w for _, w in given], 12), strict=True)
    )
    rows = substring_dedup(docs, width=12, most_contents=most_contents).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in rows) == want


@pytest.mark.parametrize("group_tokens", [2_000_000, 100])
def test_ngram_join(docs, group_tokens):
    given = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sets = {}
    for r in given.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    names = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    names[a] = names[b] = min(names[a], names[b])
    rows = ngram_join(given, group_tokens=group_tokens).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {
        i: (len(s), names[i]) for i, s in sets.items()
    }


def test_exact_dedup(docs):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup(docs, shard_digests=4).collect()}
    by_id = {i: r for (i, _), r in rows.items()}
    assert by_id[None].keep_id == 3 and not by_id[None].kept
    assert by_id[1].keep_id == 0 and by_id[0].kept and by_id[0].group_size == 2
    assert by_id[11].keep_id == 6 and by_id[10].keep_id == 7
    assert by_id[4].group_size == 3 and by_id[4].kept


def test_cuckoo_filter_deletes_and_grows():
    keys = [zlib.crc32(bytes([i])).to_bytes(4, "big") * 3 + i.to_bytes(4, "big") for i in range(256)]
    index = DigestIndex(buckets=2)
    for key in keys:
        index.add(key, 1, 5, 1)
        index.add(key, 1, 3, 1)
    assert all(key in index.filter for key in keys)
    assert index.filter.mask > 1 and all(v == (1, 3, 2) for v in index.content.values())
    small = CuckooFilter(8)
    assert small.insert(keys[0]) and keys[0] in small
    small.delete(keys[0])
    assert keys[0] not in small


def test_language_id(docs):
    rows = {r.doc_id: r for r in language_id(docs).collect()}
    assert rows[0].lang_pred == "und" and rows[2].lang_pred == "und" and rows[2].score == 0
    assert rows[7].lang_pred == "en" and 0 <= rows[7].score <= 1 and rows[None].held_out is False
    assert rows[5].held_out == (zlib.crc32(b"5") % 4 == 2)


def test_language_of_few_documents(spark):
    rng = np.random.default_rng(11)
    common, rare = ["the", "of", "and", "with"], ["ggü", "kko", "zzy", "qox"]
    rows = [(i, " ".join([*rng.choice(common, 2), *(f"n{''.join(rng.choice(list('abcdefgh'), 6))}" for _ in range(6))]), "en") for i in range(3000)]
    rows += [(3000 + i, " ".join(rng.choice(rare, 8)), "xx") for i in range(12)]
    rows += [(None, "aaap aaap", "yy")] * 50
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = language_id(table, fit_docs=40).collect()
    want = {i: lang for i, _, lang in rows}
    assert [r for r in found if r.lang_pred != want[r.doc_id]] == []


def test_language_stage_without_labels(docs):
    found = in_known_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    want = [r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    assert Counter(r.text for r in found) == Counter(want)


def test_packing(docs, spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), 0, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 700))]
    pieces = spark.createDataFrame(rows, "id bigint, row_check bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    found = best_fit_packing(pieces, room=100, shard_pieces=200).toPandas()
    assert len(found) == 700
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_.length.sum() <= 100
        assert (bin_.offset == bin_.length.cumsum() - bin_.length).all()
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 100


def test_token_files(docs, spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    write_token_files(docs, f"{tmp_path}/ids", path, end=1, by_space=False)
    rows = read_token_files(spark, f"{tmp_path}/ids").orderBy("start").collect()
    want = [
        tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for r in docs.orderBy("doc_id", "text").collect()
    ]
    assert [r.ids for r in rows] == want
    assert [r.start for r in rows] == [sum(map(len, want[:i])) for i in range(len(want))]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cut = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, room=16).toPandas()
    given = [len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]
    assert cut.length.sum() == sum(given) and (cut[cut.piece > 0].length == 16).all()


def test_source_mix(docs):
    rows = source_mix(docs, block_rows=2).toPandas()
    sums = rows.groupby("source", dropna=False).agg({"size": "sum", "target": "first", "taken": "sum"})
    assert abs(sums.target.sum() - sums["size"].sum()) < 1e-6
    assert (sums.target <= 3 * sums["size"] + 1e-6).all() and (abs(sums.taken - sums.target) <= 1).all()
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken >= 0).all()


def test_pii(docs):
    rows = {r.doc_id: r for r in find_pii(docs).collect()}
    assert rows[0].spans == "" and (rows[18].n_email, rows[18].n_ip, rows[18].n_phone) == (1, 1, 1)
    assert (rows[19].n_card, rows[19].n_ip) == (1, 0)
    assert base_spans("1" * 5000 + ".1.1.1") == []


@pytest.mark.parametrize("times", [1, 400])
def test_pii_in_other_forms(spark, times):
    other = {
        "email": "bosbt.{0} [at] mail8 [dot] example [dot] org",
        "phone": "(743) 555-{0}",
        "card": "4111.1111.1111.1111",
    }
    rows, want = [], {}
    for i in range(3 * times):
        kind, form = list(other.items())[i % 3]
        span = form.format(1000 + i)
        text = f"und +1 (743) 555-{1000 + i} ou {span} la, 2023-01-15 12-30, 4111.1111.1111.1112"
        start = text.rindex(span)
        rows.append((i, text))
        want[i] = f"{kind}:{start}:{start + len(span)}"
    found = find_pii(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    assert {r.doc_id: ",".join(s for s in r.spans.split(",") if s not in r.base.split(",")) for r in found} == want


def test_pii_in_other_forms_only(spark):
    # No base span at all, and many numbers without a plus.
    rows = [(i, f"la rue (743) 555-{1000 + i} und so") for i in range(900)]
    found = find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.base, r.spans) for r in found} == {("", "phone:7:21")}


def test_voronoi_knn(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 1) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(120, 150)]
    bad = [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (250, [float("inf")] * 4, 1)]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int")
    ints = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v, _ in rows}
    want = []
    for q in range(0, 150, 50):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    found = voronoi_knn(table, F.col("vec_id") % 50 == 0, pivots=7, block=20, queries=2)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_empty_tables(empty, spark):
    for run in (suffix_dedup, substring_dedup, ngram_join, exact_dedup, language_id, find_pii, source_mix):
        assert run(empty).count() == 0, run.__name__


def vector_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def nearest(rows, k=5):
    """Brute force; of queries with one id the smallest vector."""
    floors = [(i, [int(np.floor(c * 256)) for c in v]) for i, v in rows]
    asked = {i: min(v for j, v in floors if j == i) for i, _ in floors if i % 50 == 0}
    out = []
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in floors if j != i)
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


CLUSTERS = [(i, [100.0 * (i % 2) + i / 100, 100.0 * (1 - i % 2)]) for i in range(120)]


@pytest.mark.parametrize(
    "rows",
    [
        [(0, [1.0, 2.0])],
        [(i, [0.5, 0.5]) for i in range(10)],
        CLUSTERS,
        [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (7, [3.0, 1.0]), (8, [1.0, 3.0])],
    ],
    ids=["one row", "equal", "two clusters", "repeated queries"],
)
def test_voronoi_knn_where_no_other_cell_is_reached(spark, rows):
    for given in (rows, rows[::-1]):
        found = voronoi_knn(vector_rows(spark, given), F.col("vec_id") % 50 == 0).collect()
        assert sorted(map(tuple, found)) == nearest(rows)


def test_token_files_of_a_task_are_one_whatever_the_session_says(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i // 3 if i % 4 else None, f"text {i} " * (i % 7)) for i in range(300)], "doc_id bigint, text string"
    )
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        path = str(tmp_path / "ids")
        write_token_files(docs, path, TOKENIZER_WORDS, end=1, by_space=False)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == 300 and [r.doc_id is None for r in rows] == sorted((r.doc_id is None for r in rows), reverse=True)
    at = 0
    for row in rows:
        assert (row.start, len(row.ids)) == (at, row.n_tokens)
        at += row.n_tokens
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert ids == sorted(ids)


def test_an_empty_table_of_token_files_and_pieces(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    write_token_files(empty, path, TOKENIZER_WORDS, end=1, by_space=False)
    assert read_token_files(spark, path).count() == 0
    assert best_fit_packing(token_pieces(empty, TOKENIZER_BYTES, 2), 64).count() == 0


def test_pieces_are_cut_counted_and_hashed(spark, docs):
    """Ids, starts, lengths and checksums of every piece, from whole texts encoded one by one."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER_BYTES)
    want = Counter()
    for row in docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 16 or 16, len(ids) + 1, 16)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            data = np.array(ids[a:b], dtype="<u4").tobytes()
            want[row.doc_id, piece, a, b - a, zlib.crc32(data)] += 1
    rows = token_pieces(docs, TOKENIZER_BYTES, 2, room=16).collect()
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
