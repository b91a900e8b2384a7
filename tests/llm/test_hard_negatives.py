"""Hard negatives against brute force: ties, repeats, skewed labels, blocks, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import compare, duck
from lakehaul.llm.hard_negatives import SQL, BlockIndex, hard_negatives, op11_hard_negatives
from tests.conftest import DATA

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, norm int, row int"


def brute(rows, is_anchor, positives=5, negatives=3):
    """Every row against every anchor, in Python integers."""
    kept = [
        (i, tuple(math.floor(float(c) * 256) for c in v), label)
        for i, v, label, *_ in rows
        if i is not None and v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    anchors = {}
    for i, v, label in sorted(kept, key=lambda r: (r[0], str(r[2]), r[1])):
        if is_anchor(i):
            anchors.setdefault(i, (v, label))
    out = []
    for a, (q, own) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, label == own) for i, v, label in kept if i != a]
        for at, (p, i, _) in enumerate(sorted(s for s in scored if s[2])[:positives], 1):
            fits = sorted(s for s in scored if not s[2] and -50 * p <= -100 * s[0] <= -95 * p)
            out += [(a, i, rank, j, -p, -n, at) for rank, (n, j, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r[:3], "x", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 20))
    vectors = near[rng.integers(0, 6, 260)] + rng.normal(size=(260, 20)) * rng.choice([0.1, 0.5, 2.0], (260, 1))
    labels = np.where(rng.random(260) < 0.4, 0, rng.integers(0, 5, 260))  # one label holds a third
    out = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(vectors, labels, strict=True))]
    out += out[40:60]  # repeated rows
    out += [(60, [0.5] * 20, 1), (60, [0.25] * 20, 0)]  # repeated ids, other vectors
    out += [(300 + i, [1.0, 1.0], i % 2) for i in range(12)]  # short, and ties
    out += [(400, None, 1), (401, [], 1), (402, [None, 1.0], 1), (403, [float("nan")], 1)]
    out += [(404, [float("inf")], 2), (405, [1.0], None), (None, [1.0], 1), (406, [0.0] * 20, 1)]
    return out


@pytest.mark.parametrize("block, anchors", [(8192, 2048), (16, 4)])
def test_against_brute_force(spark, rows, block, anchors):
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, block=block, anchors=anchors)
    want = brute(rows, lambda i: i % 10 == 0)
    assert found(got) == want and len(want) > 100


def test_labels_of_one_row_and_text_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), i) for i in range(20)]
    assert found(hard_negatives(table(spark, rows), F.col("vec_id") < 5)) == []
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(40)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") < 7, label=F.concat(F.lit("l"), "label"))
    assert found(got) == brute(rows, lambda i: i < 7)


def test_vectors_too_large_for_doubles(spark):
    rows = [(i, [1e6 * (i + 1), -3e5 * i, 0.5], i % 2) for i in range(12)]
    rows += [(20, [1e30, 1.0, 1.0], 0)]
    got = hard_negatives(table(spark, rows[:12]), F.col("vec_id") < 4)
    assert found(got) == brute(rows[:12], lambda i: i < 4)
    # Beyond the range of longs a score is that range's end, and nothing fails.
    assert hard_negatives(table(spark, rows), F.col("vec_id") < 4).count() >= 0


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(i, [0.5, 0.5], 1) for i in range(10)]])
def test_empty_single_and_equal(spark, rows):
    assert found(hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0)) == []


def test_a_block_gives_every_pair_that_reaches_its_threshold():
    rng = np.random.default_rng(9)
    x, q = (np.floor(rng.normal(size=(n, 24)) * 60) for n in (500, 7))
    edges = np.array([0, 8, 16, 24])
    whole = q @ x.T
    for floor in (-1e6, 0.0, 20_000.0, 1e9):
        least = floor + rng.integers(0, 2000, 7)
        index = BlockIndex(x, edges, float(np.sqrt((q**2).sum(axis=1)).max()), float(least.min()))
        anchor, row, score = index.pairs(q, least.astype(np.float64))
        assert {*zip(anchor.tolist(), row.tolist())} == {*zip(*map(np.ndarray.tolist, np.nonzero(whole >= least[:, None])))}
        assert (score == whole[anchor, row]).all()


def test_query_and_sql(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "queries", lambda: {"q": op11_hard_negatives})
    monkeypatch.setattr(entry, "oracle_sql", lambda: {"q": SQL})
    assert compare(spark, duck(DATA), "q", DATA) == ""
