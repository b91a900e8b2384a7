"""Hard negatives by threshold joins, for integer inner products.

For every anchor the ``positives`` best rows of its label are found, and for each of them the
``negatives`` best rows of other labels whose score lies in a window below the positive's.
Both are top-k searches inside windows ``low..high`` of scores, and both go the same way:

1. Every window starts with a high threshold.  One threshold join finds, for each anchor, the
   rows whose score reaches the lowest threshold of its open windows.
2. A window that has its k rows is closed: no row below the threshold can be better.  The
   thresholds of the others are lowered and joined again; the last threshold is the window's
   lower end (for positives: none), so what is still open then has no more rows.

The join deals rows to blocks by norm class (a factor of the square root of 2) and sends an
anchor only to classes whose largest norm can reach its threshold.  Inside a block it follows
L2AP, with dimensions in ascending order of energy, taken in segments:

* *Index.*  The leading segments of a vector x are left out of the index as long as
  ``|x_lead| * |q| < threshold`` for the anchor of largest norm and the lowest threshold:
  such a part alone cannot make a pair.
* *Candidates.*  From the last segment to the first, partial scores are accumulated over the
  rows indexed there.  A pair is dropped once ``partial + |q_lead| * |x_lead|`` is below the
  anchor's threshold.  When few pairs are left, only those are accumulated further.
* *Scores.*  What is left is finished with the segments not indexed; sums of integers below
  2^53 are exact in doubles.  Vectors whose products could be larger are multiplied as Python
  integers, every pair of the block.

A block returns at most k rows per window, so no task or table holds all pairs.  The driver
sees one number per dimension and a row per norm class, of which long components allow
some 150.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakehaul.llm.shared import written
from lakehaul.llm.voronoi_knn import LONGS, matrix, products

#: Rows of a data block, anchors of an anchor block, anchors multiplied at a time.
BLOCK, ANCHORS, AT_ONCE = 8_192, 2_048, 128
#: Dimensions of a segment.
SEGMENT = 8
#: Thresholds of a positives' window as shares of the largest possible score (last: none),
#: and of a negatives' window as shares of its height, from its upper end down.
POSITIVE_LEVELS, NEGATIVE_LEVELS = (0.5, 0.25, 0.0, None), (0.25, 1.0)
#: Share of pairs left from which they are followed one by one.
FEW = 0.125

WINDOWS = "array<struct<slot:int,low:bigint,high:bigint>>"
FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def energies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of squares per dimension, of each batch."""
    for rows in batches:
        squares = (matrix(rows["vector"].tolist()).astype(np.float64) ** 2).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(len(squares)), "energy": squares})


def leading_norms(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Norm of each row's part before each segment edge."""
    squares = np.zeros((len(x), x.shape[1] + 1))
    np.cumsum(x**2, axis=1, out=squares[:, 1:])
    return np.sqrt(squares[:, edges])


class BlockIndex:
    """Inverted index of a block: per segment the rows that are indexed there."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, longest: float, lowest: float):
        lead = leading_norms(x, edges)
        #: Segments of each row that are not indexed, from the first on.
        unindexed = (reachable(0.0, longest, lead) < lowest).sum(axis=1) - 1
        # A row whose whole norm is too small is in no segment at all.
        self.order = np.argsort(unindexed, kind="stable")
        self.x, self.lead = x[self.order], lead[self.order]
        self.skip = np.maximum(unindexed[self.order], 0)
        self.edges = edges
        segments = len(edges) - 1
        self.rows = np.searchsorted(unindexed[self.order], np.arange(segments), side="right")
        self.any = int(self.rows[-1]) if segments else 0

    def pairs(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of every pair that reaches the anchor's threshold."""
        n, edges = self.any, self.edges
        q_lead = leading_norms(q, edges)
        partial = np.zeros((len(q), n))
        alive = None
        s = len(edges) - 1
        while s > 0:
            s -= 1
            m, part = self.rows[s], slice(edges[s], edges[s + 1])
            partial[:, :m] += q[:, part] @ self.x[:m, part].T
            if 2 * s > len(edges):
                continue
            # A row not indexed here stands where its index ends.
            at = np.maximum(self.skip[:n], s)
            rest = q_lead[:, at] * self.lead[np.arange(n), at]
            alive = reachable(partial, rest, 1.0) >= least[:, None]
            if np.count_nonzero(alive) <= FEW * alive.size:
                break
        if alive is None:
            alive = np.ones(partial.shape, dtype=bool)
        anchor, row = np.nonzero(alive)
        score = partial[anchor, row]
        done = np.maximum(self.skip[row], s)
        for s in range(int(done.max()) - 1 if len(done) else -1, -1, -1):
            part = slice(edges[s], edges[s + 1])
            here = done > s
            score[here] += np.einsum("ij,ij->i", q[anchor[here], part], self.x[row[here], part])
            rest = np.where(here, q_lead[anchor, s] * self.lead[row, s], np.inf)
            kept = reachable(score, rest, 1.0) >= least[anchor]
            anchor, row, score, done = anchor[kept], row[kept], score[kept], done[kept]
        kept = score >= least[anchor]
        return anchor[kept], self.order[row[kept]], score[kept].astype(np.int64)


def reachable(partial, longest, norm):
    """The most a score can become; rounding of doubles must not cut a tie off."""
    return partial + longest * norm * (1 + 1e-9) + 0.5


def search_block(order: list[int], k: int, same: bool) -> Callable:
    """Per window of each anchor its k best rows of a block, ties to the smaller id."""

    def run(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("anchor_id", "int64"), ("slot", "int32"), ("vec_id", "int64"), ("score", "int64"))})]
        if not len(asked) or not len(data):
            return out[0]
        width = len(order)
        x, q = (matrix(side["vector"].tolist(), width) for side in (data, asked))
        ids, own = data["vec_id"].to_numpy(), asked["anchor_id"].to_numpy()
        codes = pd.factorize(pd.concat([data["label"], asked["label"]]))[0]
        labels, own_labels = codes[: len(data)], codes[len(data) :]
        windows = [
            [(w["slot"], w["low"], w["high"]) for w in ws] for ws in asked["windows"].tolist()
        ]
        lowest = np.array([min(low for _, low, _ in ws) for ws in windows], dtype=np.float64)
        most = max(int(abs(m).max()) for m in (x, q)) if width else 0
        exact = x.dtype == q.dtype == np.float64 and most**2 * width < 1 << 53
        if exact:
            edges = np.array([*range(0, width, SEGMENT), width])
            x, q = x[:, order], q[:, order]
            longest = float(np.sqrt((q**2).sum(axis=1)).max())
            index = BlockIndex(x, edges, longest, float(lowest.min()))
        for at in range(0, len(asked), AT_ONCE):
            end = min(at + AT_ONCE, len(asked))
            if exact:
                anchor, row, score = index.pairs(q[at:end], lowest[at:end])
            else:
                whole = products(asked["vector"].tolist()[at:end], data["vector"].tolist())
                anchor, row = (a.ravel() for a in np.indices(whole.shape))
                score = whole.ravel()
            anchor = anchor + at
            fits = (ids[row] != own[anchor]) & ((labels[row] == own_labels[anchor]) == same)
            anchor, row, score = anchor[fits], row[fits], score[fits]
            # By anchor, highest score first, then smaller id; ~score cannot overflow.
            best = np.lexsort((ids[row], ~score, anchor))
            anchor, row, score = anchor[best], row[best], score[best]
            bounds = np.searchsorted(anchor, np.arange(at, end + 1))
            for i in range(at, end):
                mine = slice(bounds[i - at], bounds[i - at + 1])
                falling, those = ~score[mine], row[mine]
                for slot, low, high in windows[i]:
                    first = np.searchsorted(falling, ~np.int64(high), side="left")
                    last = min(np.searchsorted(falling, ~np.int64(low), side="right"), first + k)
                    if first < last:
                        out.append(
                            pd.DataFrame(
                                {"anchor_id": own[i], "slot": np.int32(slot), "vec_id": ids[those[first:last]], "score": ~falling[first:last]}
                            )
                        )
        return pd.concat(out, ignore_index=True)

    return run


class Rows:
    """The rows searched: blocks by norm class, and what is known of each class."""

    def __init__(self, rows: DataFrame, block: int, anchors: int):
        self.rows, self.anchors = rows, anchors
        energy = rows.select("vector").mapInPandas(energies, "at int, energy double")
        self.order = [r["at"] for r in energy.groupBy("at").agg(F.sum("energy").alias("e")).orderBy("e", "at").collect()]
        self.classes = [
            (r["class"], r["norm"], -(-r["rows"] // block))
            for r in rows.groupBy("class").agg(F.max("norm").alias("norm"), F.count(F.lit(1)).alias("rows")).collect()
        ]
        self.largest = max((norm for _, norm, _ in self.classes), default=0.0)

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """``asked`` has ``anchor_id``, ``label``, ``vector``, ``norm`` and ``windows``."""
        if not self.classes:
            return self.rows.sparkSession.createDataFrame([], FOUND)
        classes = F.array(
            *[
                F.struct(F.lit(c).alias("class"), F.lit(norm).alias("norm"), F.lit(blocks).alias("blocks"))
                for c, norm, blocks in self.classes
            ]
        )
        low = F.array_min(F.transform("windows", lambda w: w["low"]))
        sent = asked.withColumn(
            "to",
            F.explode(
                F.filter(classes, lambda c: F.col("norm") * c["norm"] * (1 + 1e-9) + 0.5 >= low)
            ),
        )
        counts = {r["class"]: r["n"] for r in sent.groupBy("to.class").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return self.rows.sparkSession.createDataFrame([], FOUND)
        parts = {c: (blocks, -(-counts[c] // self.anchors)) for c, _, blocks in self.classes if c in counts}

        def of_class(column: Column, at: int) -> Column:
            pairs = [F.lit(v) for c, both in parts.items() for v in (c, both[at])]
            return F.create_map(*pairs)[column]

        ask = sent.select(
            F.col("to.class").alias("class"),
            F.pmod(F.xxhash64("anchor_id"), of_class(F.col("to.class"), 1)).cast("int").alias("q_block"),
            F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)).alias("block"),
            "anchor_id", "label", "vector", "windows",
        )
        data = self.rows.where(F.col("class").isin(list(parts))).select(
            "class",
            F.explode(F.sequence(F.lit(0), of_class(F.col("class"), 1) - 1)).alias("q_block"),
            F.pmod(F.xxhash64("row_no"), of_class(F.col("class"), 0)).cast("int").alias("block"),
            "vec_id", "label", "vector",
        )
        keys = ["class", "block", "q_block"]
        return (
            ask.groupBy(*keys)
            .cogroup(data.groupBy(*keys))
            .applyInPandas(search_block(self.order, k, same), FOUND)
        )

    def fill(self, open_: DataFrame, levels: tuple, threshold: Callable, k: int, same: bool) -> DataFrame:
        """The k best rows of every window; ``open_`` has a row per window, with ``anchor_id``,
        ``slot``, ``low`` and ``high``, and the anchor's ``label``, ``vector`` and ``norm``."""
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        done = None
        for at, level in enumerate(levels):
            now = open_.withColumn("least", F.greatest("low", threshold(level)))
            asked = now.groupBy("anchor_id").agg(
                F.first("label").alias("label"),
                F.first("vector").alias("vector"),
                F.first("norm").alias("norm"),
                F.collect_list(F.struct("slot", F.col("least").alias("low"), "high")).cast(WINDOWS).alias("windows"),
            )
            found = written(
                self.search(asked, k, same)
                .withColumn("rank", F.row_number().over(order))
                .where(F.col("rank") <= k),
                "windows",
            )
            if at + 1 == len(levels):
                return found if done is None else done.union(found)
            full = found.where(F.col("rank") == k).select("anchor_id", "slot")
            closed = found.join(full, ["anchor_id", "slot"], "left_semi")
            done = closed if done is None else done.union(closed)
            open_ = written(open_.join(full, ["anchor_id", "slot"], "left_anti"), "open-windows")
            if open_.isEmpty():
                return done
        return done


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    block: int = BLOCK,
    anchors: int = ANCHORS,
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives below the positive.

    Components x count as ``floor(256 * x)``, and a score is the integer inner product with
    the anchor (beyond the range of longs: its end).  An anchor's positives are the
    ``positives`` best other rows of its label, a positive's negatives the ``negatives`` best
    rows of other labels whose score is at least 50 % and at most 95 % of the positive's;
    ties go to the smaller id.  Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score``, ``negative_score`` and ``positive_rank``.

    ``label`` (default: column ``label``) may have any type that casts to text.  Rows take no
    part if their id, label or vector is null or a component is null, infinite or NaN.
    Vectors of different lengths are compared as if filled up with zeros.  Rows with one id
    are candidates each, but never for an anchor of that id; of several anchors with one id
    the one with the smallest label and vector is asked.  An anchor without positives, or a
    positive without negatives, has no row; an empty table gives none.  Other columns are
    not looked at.
    """
    value = F.col(vector_col)
    label = F.col("label") if label is None else label
    finite = F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = written(
        vectors.select(
            F.col(id_col).cast("bigint").alias("vec_id"),
            label.cast("string").alias("label"),
            F.when(finite, F.transform(value, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))).alias("vector"),
            is_anchor.alias("is_anchor"),
        )
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
        .withColumn("norm", F.sqrt(square))
        .withColumn("class", F.floor(2 * F.log2(F.greatest("norm", F.lit(1.0)))).cast("int"))
        .withColumn("row_no", F.monotonically_increasing_id()),
        "labelled-vectors",
    )
    searched = Rows(rows, block, anchors)
    asked = written(
        rows.where("is_anchor")
        .groupBy(F.col("vec_id").alias("anchor_id"))
        .agg(F.min(F.struct("label", "vector", "norm")).alias("a"))
        .select("anchor_id", "a.*"),
        "anchors",
    )

    def share_of_most(level: float | None) -> Column:
        if level is None:
            return F.lit(LONGS.min)
        # No higher than a long: a lower threshold is right as well.
        return F.least(F.col("norm") * searched.largest * level, F.lit(9e18)).cast("bigint")

    everything = asked.select(
        "*", F.lit(0).alias("slot"), F.lit(LONGS.min).alias("low"), F.lit(LONGS.max).alias("high")
    )
    best = written(
        searched.fill(everything, POSITIVE_LEVELS, share_of_most, positives, True).select(
            "anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # 50 p <= 100 n <= 95 p, without products that could overflow.
    # Below 0 there is no such n.
    low = F.expr("positive_score div 2 + positive_score % 2")
    high = F.expr("positive_score div 20 * 19 + 19 * (positive_score % 20) div 20")
    below = (
        best.select(
            "anchor_id", "slot", F.when(F.col("positive_score") >= 0, F.struct(low.alias("low"), high.alias("high"))).alias("w")
        )
        .select("anchor_id", "slot", "w.low", "w.high")
        .where("low <= high")
        .join(asked, "anchor_id")
    )

    def share_of_window(level: float) -> Column:
        height = F.col("high").cast("double") - F.col("low")
        return F.col("high") - F.ceil(height * level).cast("bigint")

    found = searched.fill(below, NEGATIVE_LEVELS, share_of_window, negatives, False)
    return found.join(best, ["anchor_id", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
        F.col("slot").alias("positive_rank"),
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """A seventh of the labels is shifted first, as the contract says."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=shifted)


SQL = """
    WITH v AS (
        SELECT vec_id,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE) for c in embedding] AS x
        FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL
          AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same,
               CAST(list_dot_product(a.x, o.x) AS BIGINT) AS score
        FROM v AS a JOIN v AS o ON a.vec_id <> o.vec_id AND a.vec_id % 50 = 0),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
        FROM s WHERE same QUALIFY positive_rank <= 5)
    SELECT p.anchor_id, p.positive_id,
           CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
           p.positive_score, s.score AS negative_score,
           CAST(p.positive_rank AS INTEGER) AS positive_rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_rank ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 3"""
