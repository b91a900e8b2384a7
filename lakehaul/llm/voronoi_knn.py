"""Exact top-k search by a Voronoi join, for integer inner products.

Pivots divide all vectors into cells, each vector going to its nearest pivot.  A cell's
summary is its size and its radius r, the largest distance from its pivot p.  For a
query q and any x of the cell, ``q.x = q.p + q.(x - p) <= q.p + |q| r``.

1. Queries are grouped with the data of their own cell and solved there: the k-th score
   found is a bound that any other answer has to reach.
2. A query is then sent to exactly those other cells whose upper bound reaches its own
   bound, and solved there.  Ties are kept: a cell is left out only if its bound is less.
3. The best k of all answers remain.

Only queries are replicated, not data.  Cells are cut into blocks of ``BLOCK`` vectors
and their queries into blocks too, so no task holds a large cell, and each block returns k
rows per query at most.  Summaries, and as many vectors as there are pivots, are all that reaches
the driver; their number is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakehaul.llm.shared import written

#: Pivots, vectors of a data block, and queries of a query block, at most.
PIVOTS, BLOCK, QUERIES = 128, 20_000, 4_000

CELLED = "vec_id bigint, vector array<bigint>, is_query boolean, cell int, distance double"
FOUND = "query_id bigint, vec_id bigint, score bigint"
LONGS = np.iinfo(np.int64)


def matrix(vectors, width: int = 0) -> np.ndarray:
    """Rows of equal width, short ones filled with zeros; exact as doubles or else as
    Python integers."""
    width = max(width, max((len(v) for v in vectors), default=0))
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    most = max(-int(out.min()), int(out.max())) if out.size else 0
    return out.astype(np.float64) if most * most * max(width, 1) < 1 << 53 else out.astype(object)


def products(queries: list, vectors: list) -> np.ndarray:
    """All inner products, as longs (beyond their range: its end)."""
    width = max((len(v) for v in [*queries, *vectors]), default=0)
    a, b = matrix(queries, width), matrix(vectors, width)
    most = max((abs(x).max() for x in (a, b) if x.size), default=0)
    if a.dtype == object or b.dtype == object or int(most) ** 2 * max(width, 1) >= 1 << 53:
        whole = a.astype(object) @ b.astype(object).T
        return np.clip(whole, LONGS.min, LONGS.max).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def to_cells(pivots: np.ndarray) -> Callable:
    norms = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 4096):
                part = rows.iloc[at : at + 4096]
                x = matrix(part["vector"].tolist(), pivots.shape[1]).astype(np.float64)
                p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
                squares = (x**2).sum(axis=1)[:, None] + norms - 2 * x @ p.T
                cell = squares.argmin(axis=1)
                away = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                yield part.assign(cell=cell.astype(np.int32), distance=away)

    return run


def best_of(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best vectors of a block for each query, ties to the smaller id."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("query_id", "vec_id", "score")})
        if not len(queries) or not len(data):
            return none
        data = data.sort_values("vec_id")
        ids = data["vec_id"].to_numpy()
        vectors = data["vector"].tolist()
        out = [none]
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            scores = products(part["vector"].tolist(), vectors)
            for query, row in zip(part["query_id"].to_numpy(), scores, strict=True):
                other = np.flatnonzero(ids != query)
                mine = row[other]
                if len(mine) > k:
                    edge = np.partition(mine, len(mine) - k)[len(mine) - k]
                    # The first of those at the edge are the ones with smaller ids.
                    above, level = np.flatnonzero(mine > edge), np.flatnonzero(mine == edge)
                    pick = np.concatenate([above, level[: k - len(above)]])
                else:
                    pick = np.arange(len(mine))
                out.append(
                    pd.DataFrame({"query_id": query, "vec_id": ids[other[pick]], "score": mine[pick]})
                )
        return pd.concat(out, ignore_index=True)

    return run


def reachable(pivots: np.ndarray, radii: np.ndarray) -> Callable:
    """For each query the cells, other than its own, that may hold a better vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = matrix(rows["vector"].tolist(), pivots.shape[1]).astype(np.float64)
            p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            # Rounding of doubles must not cut a tie off.
            most = (x @ p.T + length * radii) * (1 + 1e-9 * np.sign(x @ p.T + length * radii)) + 1
            wanted = (most >= rows["bound"].to_numpy()[:, None]) & (radii >= 0)
            wanted[np.arange(len(rows)), rows["cell"].to_numpy()] = False
            row, cell = np.nonzero(wanted)
            yield pd.DataFrame(
                {
                    "query_id": rows["query_id"].to_numpy()[row],
                    # A batch may reach no other cell; without a type it would be one of floats.
                    "vector": pd.Series([rows["vector"].iloc[i] for i in row], dtype=object),
                    "cell": cell.astype(np.int32),
                }
            )

    return run


def solve(queries: DataFrame, data: DataFrame, sizes: DataFrame, k: int, query_rows: int) -> DataFrame:
    """Queries against the data of the cell they come with, block by block."""
    amounts = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("q_blocks"))
    plan = F.broadcast(sizes.join(amounts, "cell"))  # a row per pivot
    ask = (
        queries.join(plan, "cell")
        .withColumn("q_block", F.pmod(F.xxhash64("query_id"), "q_blocks").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", "block", "q_block", "query_id", "vector")
    )
    rows = (
        data.join(plan, "cell")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .select("cell", "block", "q_block", "vec_id", "vector")
    )
    keys = ["cell", "block", "q_block"]
    return ask.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best_of(k), FOUND)


def voronoi_knn(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    block: int = BLOCK,
    queries: int = QUERIES,
) -> DataFrame:
    """The k vectors of largest inner product with each query, the query itself left out.

    Components x count as ``floor(256 * x)``.  Returns ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score``; ties go to the smaller id.  ``is_query`` is a condition on
    the rows.  Rows take no part if their id or vector is null or a component is null, infinite or NaN.
    Vectors of different lengths are compared as if filled up with zeros; rows with one
    id are candidates each but never for a query of that id; of several queries with one id the
    smallest vector is asked.  Scores beyond the range of
    longs are its ends.  Other columns are not looked at.  Fewer than k candidates give
    fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col)
    finite = F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    rows = written(
        vectors.where(F.col(id_col).isNotNull() & value.isNotNull() & finite).select(
            F.col(id_col).cast("bigint").alias("vec_id"),
            F.transform(value, lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
            is_query.alias("is_query"),
        ),
        "vectors",
    )
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    centres = matrix([r["vector"] for r in chosen]).astype(np.float64)
    celled = written(rows.mapInPandas(to_cells(centres), CELLED), "cells")
    sizes = written(
        celled.groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
            F.max("distance").alias("radius"),
        ),
        "cell-sizes",
    )
    radii = np.full(len(chosen), -1.0)
    for row in sizes.collect():
        radii[row["cell"]] = row["radius"]
    sizes = sizes.select("cell", "blocks")
    data = celled.select("vec_id", "vector", "cell")
    asked = written(
        celled.where("is_query")
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min(F.struct("vector", "cell")).alias("q"))
        .select("query_id", "q.*"),
        "queries",
    )
    near = written(solve(asked, data, sizes, k, queries), "near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == k)
        .select("query_id", F.col("score").alias("bound"))
    )
    further = asked.join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(LONGS.min)).cast("double")
    )
    sent = further.mapInPandas(
        reachable(centres, radii), "query_id bigint, vector array<bigint>, cell int"
    )
    far = solve(written(sent, "sent"), data, sizes, k, queries)
    return (
        near.union(far)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return voronoi_knn(vectors, F.col("vec_id") % 50 == 0)


SQL = """
    WITH v AS (
        SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE) for c in embedding] AS x
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 5"""
