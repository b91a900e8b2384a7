"""Language identification by words first, backing off to shorter and shorter n-grams.

A known word counts with its log frequency in each language.  A word that no language
knows is spelled: at every place of it (with its ends marked) the longest known
character n-gram, of 4 down to 1 characters, counts instead, and the word counts as
the mean of its places.  The word's evidence is what its languages' values differ by.
A text's score is the share of the best language if evidence is added up and
exponentiated.

The tables are learned from about ``FIT_DOCS`` labelled documents, chosen by hash (all, if
there are fewer), and hold the most frequent ``WORDS`` words and ``GRAMS`` n-grams of each
length for each language.  The sample is drawn per language: a language of at most
``LANG_DOCS`` documents is learned from all of them, and one of more from at least about as
many, so the size of the table loses no language.  Prediction reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lakehaul.llm.shared import giving_back, held_by_worker, written

#: Labelled documents that the tables are learned from, about, and those of each language
#: that are learned from in any case.
FIT_DOCS, LANG_DOCS = 20_000, 1_000
#: Words and n-grams of one length, per language, in the tables.
WORDS, GRAMS = 40_000, 10_000
#: Characters of the longest n-gram, and of a word (the rest of longer ones is other words).
LONGEST, WORD_CHARS = 4, 40
#: Scores of words that one worker remembers.
REMEMBERED = 100_000
#: Texts that one worker scores at a time.
TOGETHER = 256

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % WORD_CHARS)
FEATURES = "lang string, kind int, feature string, n bigint"


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and n-grams (kind: their length), by batch."""
    held_by_worker("language")
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(
            batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True
        ):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, counts in words.items():
            grams: list[Counter] = [counts, *(Counter() for _ in range(LONGEST))]
            for word, n in counts.items():
                marked = f"_{word}_"
                for size in range(1, LONGEST + 1):
                    for at in range(len(marked) - size + 1):
                        grams[size][marked[at : at + size]] += n
            for kind, found in enumerate(grams):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(lang, len(found)),
                        pa.repeat(pa.scalar(kind, pa.int32()), len(found)),
                        pa.array(list(found), pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    ["lang", "kind", "feature", "n"],
                )


def sampled(labelled: DataFrame, fit_docs: int) -> DataFrame:
    """All rows of ``id``, ``text`` and ``lang`` up to ``fit_docs``.  Of more, each language's
    share of ``fit_docs``, but ``LANG_DOCS`` documents (all, if it has fewer) at least."""
    scale = 1 << 40
    drawn = labelled.withColumn("draw", F.pmod(F.xxhash64("id", "text"), F.lit(scale)))
    sizes = written(
        drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")), "language-sizes"
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= fit_docs:
        return labelled
    wanted = F.greatest(F.col("n") * fit_docs / total, F.lit(min(LANG_DOCS, fit_docs)))
    # The first one drawn belongs to the sample even if no other does.
    limits = sizes.select("lang", F.greatest(wanted / F.col("n") * scale, F.col("least") + 1).alias("limit"))
    return drawn.join(F.broadcast(limits), "lang").where(F.col("draw") < F.col("limit"))


def fit(docs: DataFrame, fit_docs: int, words: int, grams: int) -> dict:
    """Languages, and for each kind the evidence of its features."""
    labelled = sampled(docs.where("learn AND lang IS NOT NULL AND text IS NOT NULL"), fit_docs)
    counts = written(
        labelled.select("lang", "text")
        .mapInArrow(count_features, FEATURES)
        .groupBy("lang", "kind", "feature")
        .agg(F.sum("n").alias("n")),
        "language-counts",
    )
    totals = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "feature")
    frequent = counts.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= F.when(F.col("kind") == 0, words).otherwise(grams)
    )
    langs = sorted({lang for _, lang in totals})
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    found = frequent.select("lang", "kind", "feature", "n").toPandas()
    for lang, kind, feature, n in zip(found["lang"], found["kind"], found["feature"], found["n"], strict=True):
        row = tables[kind].get(feature)
        if row is None:
            row = tables[kind][feature] = np.zeros(len(langs), dtype=np.float32)
        row[place[lang]] = n
    evidence = []
    for kind, table in enumerate(tables):
        sums = np.array([totals.get((kind, lang), 0) for lang in langs], dtype=np.float64)
        matrix = np.array(list(table.values()), dtype=np.float64).reshape(len(table), len(langs))
        # A feature that a language lacks has one value in all, however much each has been
        # learned from; else those of few documents would attract the rare words of the rest.
        logs = np.log(matrix / np.maximum(sums, 1) + 0.5 / max(sums.max(initial=0), 1))
        logs -= logs.mean(axis=1, keepdims=True) if len(table) else 0
        evidence.append(dict(zip(table, logs.tolist(), strict=True)))
    return {"langs": langs, "evidence": evidence}


class Scorer:
    """Evidence of words, remembered."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words = model["evidence"][0]
        self.grams = model["evidence"][1:]
        self.none = [0.0] * len(self.langs)
        self.known: dict[str, list[float]] = {}

    def spelled(self, word: str) -> list[float]:
        marked = f"_{word}_"
        rows = []
        for at in range(len(marked)):
            for size in range(LONGEST, 0, -1):
                row = self.grams[size - 1].get(marked[at : at + size]) if at + size <= len(marked) else None
                if row is not None:
                    rows.append(row)
                    break
        return [sum(column) / len(rows) for column in zip(*rows, strict=True)] if rows else self.none

    def word(self, word: str) -> list[float]:
        row = self.words.get(word) or self.known.get(word)
        if row is None:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            row = self.known[word] = self.spelled(word)
        return row

    def text(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        counts = Counter(LETTERS.findall(text.lower()))
        if counts:
            rows = np.array([self.word(w) for w in counts])
            total = np.array(list(counts.values()), dtype=np.float64) @ rows
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def predict(model, text_col: str) -> Callable:
    """Adds the language to rows in a struct column ``row``; the model is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker("language")
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = pc.struct_field(part.column("row"), text_col).to_pylist()
                found = [scorer.text(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([lang for lang, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return giving_back(run)


def held_out(id_col: str):
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_docs: int = FIT_DOCS,
    words: int = WORDS,
    grams: int = GRAMS,
) -> DataFrame:
    """The language of every text: the id, ``held_out``, ``lang_pred`` and ``score``.

    Learns from rows that are not held out and have a language.  A text that is null or
    has no letter, and every text if nothing could be learned, is ``und`` with score 0.
    A tie goes to the language that is first by name.  Rows without an id are not held
    out.  Repeated rows are learned from, and predicted, each.  Other columns are not
    looked at.  An empty table gives no rows.
    """
    rows = with_language(docs, id_col, text_col, lang_col, fit_docs, words, grams)
    return rows.select(
        F.col(f"row.{id_col}").alias(id_col), "held_out", "lang_pred", "score"
    )


def with_language(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_docs: int, words: int, grams: int
) -> DataFrame:
    """``row`` (the columns of ``docs``), ``held_out``, ``lang_pred`` and ``score``."""
    learnable = docs.select(
        F.col(id_col).alias("id"),
        (~held_out(id_col)).alias("learn"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(fit(learnable, fit_docs, words, grams))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        held_out(id_col).alias("held_out"),
    )
    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return rows.mapInArrow(predict(shared, text_col), StructType([*rows.schema.fields, *more]))


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages; if none could be
    learned, those whose text has a letter."""
    rows = with_language(docs, id_col, text_col, "lang", FIT_DOCS, WORDS, GRAMS)
    known = (F.col("lang_pred") != UNKNOWN) | F.col(f"row.{text_col}").rlike(r"\p{L}")
    return rows.where(known).select("row.*")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs.select("doc_id", "text", "lang"))
