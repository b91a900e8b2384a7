"""What the operators hold in memory and move between tasks."""

import types
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lakehaul.llm import language_id, ngram_join, packing, shared
from lakehaul.llm.token_files import read_token_files, write_token_files
from lakehaul.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_reading_token_files_moves_no_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end=1, by_space=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_token_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_are_packed_in_small_parts(monkeypatch):
    sizes = []

    class Spy:
        def encode_spaced(self, texts):
            sizes.append(pc.sum(pc.binary_length(texts)).as_py())
            return np.zeros(len(texts), "<u4"), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "encoder", lambda path, by_space: Spy())
    texts = ["x" * (1 << 20)] * 12 + ["y" * (9 << 20), "z"]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["id", "row_check", "text"])
    out = list(packing.cut_rows("", 2, 1024)(iter([batch])))
    assert sum(b.num_rows for b in out) == len(texts) and sum(sizes) == sum(map(len, texts))
    assert sorted(sizes)[-2] <= 5 << 20


def test_a_worker_holds_the_tables_of_one_operator():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = weakref.ref(encoder(path, True))
    assert first() is not None and encoder(path, True) is first()
    row = pa.array([{"text": "a b"}])
    batch = pa.RecordBatch.from_arrays([row], ["row"])
    model = types.SimpleNamespace(value={"langs": ["en"], "evidence": [{"a": [0.0]}, {}, {}, {}, {}]})
    (out,) = language_id.predict(model, "text")(iter([batch]))
    assert out.column("lang_pred").to_pylist() == ["en"]
    assert first() is None
    assert encoder(path, True).encode(["a b"])


def test_learning_a_language_lets_the_encoders_go():
    first = weakref.ref(encoder(public_tokenizers.path("byte_bpe_50k.json"), True))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b"])], ["lang", "text"])
    assert list(language_id.count_features(iter([batch])))
    assert first() is None


def texts_with_keys(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    key = pa.StructArray.from_arrays([ids, ids], ["id", "check"])
    return pa.RecordBatch.from_arrays([key, ids, ids, ids, pa.array(texts)], ["key", "class", "group", "blocks", "text"])


def shares_of_a_token():
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([1, 1], [1, 2], [5, 5])], ["token", "class", "n"])


@pytest.mark.parametrize(
    ("run", "batch"),
    [
        (lambda: ngram_join.make_sets(5, 80, bytes(1 << 19), 16), lambda: texts_with_keys(["a b c", None, ""])),
        (lambda: ngram_join.token_rows(5), lambda: texts_with_keys(["a b c", None, ""])),
        (lambda: ngram_join.fetch_sets(5), lambda: texts_with_keys(["a b c", None, ""])),
        (lambda: ngram_join.share_rows(80, 256), shares_of_a_token),
        (
            lambda: language_id.predict(types.SimpleNamespace(value={"langs": [], "evidence": [{}] * 5}), "text"),
            lambda: pa.RecordBatch.from_arrays([pa.array([{"text": "a b"}])], ["row"]),
        ),
    ],
    ids=["make_sets", "token_rows", "fetch_sets", "share_rows", "predict"],
)
def test_a_worker_gives_freed_memory_back_when_its_task_ends(monkeypatch, run, batch):
    gone, released = [], []

    def batches():
        yield batch()
        gone.append(True)

    monkeypatch.setattr(shared, "release_unused", lambda: released.append(bool(gone)))
    assert sum(b.num_rows for b in run()(batches()))
    assert released and released[-1]
