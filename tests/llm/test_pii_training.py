"""What op2's trees learn from."""

import numpy as np

from lakehaul.llm import pii


def test_every_document_is_learned_from(spark, monkeypatch):
    sums = {}
    kept = pii.written

    def written(df, name):
        out = kept(df, name)
        if name == "counted-examples":
            sums["n"] = out.agg({"n": "sum"}).first()[0]
        return out

    monkeypatch.setattr(pii, "written", written)
    monkeypatch.setattr(pii, "TREES", 2)
    docs = spark.range(25_000).selectExpr("id AS doc_id", "concat('card 4111-1111-1111-1111 of ', id) AS text")
    each = len(pii.described("card 4111-1111-1111-1111 of 7"))
    assert each > 0
    pii.find_pii(docs)
    assert sums["n"] == 25_000 * each + sum(len(pii.described(text)) for text in pii.seeds())


def test_a_tree_has_the_best_splits_of_all_rows(spark):
    """The first tree's first split against one searched by hand."""
    rng = np.random.default_rng(4)
    width = len(pii.features(0, "", "", ""))
    x = rng.integers(0, 20, (600, width)).astype(float)
    x[:, 0] = rng.choice([0, 2, 3], 600)
    y = ((x[:, 5] > 11) ^ (rng.random(600) < 0.1)).astype(int)
    rows = [([float(v) for v in a], int(b), i % 2) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    model = pii.train(spark.createDataFrame(rows, "x array<double>, y int, half int").repartition(5))
    fit_x, g = x[::2], y[::2] - y[::2].mean()
    h = y[::2].mean() * (1 - y[::2].mean())

    def gain(feature, cut):
        low = fit_x[:, feature] <= cut
        return sum(g[side].sum() ** 2 / (h * side.sum() + 1) for side in (low, ~low))

    best = max((gain(f, c), f, c) for f in range(width) for c in np.unique(fit_x[:, f])[:-1])
    first = model.trees[0]
    assert first.feature[0] == best[1] == 5 and (fit_x[:, 5] <= first.cut[0]).sum() == (fit_x[:, 5] <= best[2]).sum()
    assert len(model.trees) == pii.TREES
