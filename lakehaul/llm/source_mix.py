"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the copies the mix takes of it.  Of all rates that meet each
source's target of words, those nearest to equal ones (in relative entropy) are
exponentially tilted: ``exp(lambda_s * z)`` with z the document's share of its source's
mean size, capped at ``MOST`` copies.  The convex dual has one lambda per source.  Newton
steps find it; each is an aggregation of (source, size) counts, which are far fewer than
documents and are the only rows that the iteration reads.

Rates become copies by systematic rounding: along the documents of a source in order of
size, the running sum of rates is rounded, and each document takes the difference.  The
sums run over salted blocks of a source, whose totals are summed first, so no task holds
a whole source.  What rounding leaves over a source's target, or short of it, the next
documents in that order take or give as part of a copy.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakehaul.llm.shared import WORD, row_key, written

#: Copies of a document at most, and of a source's words.
MOST = 3
#: Documents of one block of running sums, about.
BLOCK_ROWS = 20_000
#: Newton steps at most, and the relative error that is near enough: rounding copies
#: evens out what is left.
STEPS, ENOUGH = 40, 1e-4
#: Rates are rounded to this, so that sums don't depend on the order of rows.
UNIT = 1_000_000


def words_in(text: Column) -> Column:
    """The number of words, at the price of one pass over the text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int) -> DataFrame:
    """``source``, ``source_size`` and ``target``, a row per source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...  A target above ``most``
    times its source is cut there and the excess goes to the others by weight.  A
    source is full at the common level (words per weight) where its cut lies, so the
    sources fill up in order of ``size / weight``: sums along that order give the level.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = sums.withColumn(
        "weight",
        (
            F.row_number().over(everything.orderBy(F.asc_nulls_last(F.encode("source", "UTF-8")))) - 1
        )
        % 3
        + 1,
    )
    by_level = everything.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything)
        - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn(
        "full", F.col("level") * F.col("weight") >= most * F.col("source_size")
    )
    # Up to the last full source all are full; the first open one has the final level.
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.select(
        "source",
        "source_size",
        F.when(F.col("full"), most * F.col("source_size"))
        .otherwise(common * F.col("weight"))
        .cast("double")
        .alias("target"),
    )


def tilts(sizes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """``source``, ``mean`` and ``tilt``, which solves the dual: a row per source with words.

    A source takes ``sum(size * min(most, exp(tilt * size / mean)))`` words, which grows
    with the tilt.  Each round sums it and its slope over all documents; a Newton step
    that leaves the bracket known so far is replaced by halving, so it always converges.
    Sums are of rounded numbers: reruns agree.
    """
    groups = written(
        sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")),
        "sizes",
    )
    means = groups.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean")
    )
    state = written(
        goals.where("source_size > 0")
        .withColumn("name", F.col("source"))
        .drop("source")
        .join(means, F.col("name").eqNullSafe(F.col("source")))
        .select(
            "source",
            "mean",
            "target",
            "source_size",
            F.log(F.greatest("target", F.lit(1e-9)) / F.col("source_size")).alias("tilt"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.lit(False).alias("done"),
        ),
        "tilts",
    )
    for _ in range(STEPS):
        names = state.withColumnRenamed("source", "name")
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * z))
        words = F.round(F.col("docs") * F.col("size") * rate * 1000).cast("decimal(38,0)")
        slope = F.when(rate < most, F.round(F.col("docs") * F.col("size") * rate * z * 1000)).otherwise(0)
        sums = (
            groups.join(names, F.col("source").eqNullSafe(F.col("name")))
            .groupBy("source", "mean", "target", "source_size", "tilt", "low", "high", "done")
            .agg(
                (F.sum(words).cast("double") / 1000 - F.col("target")).alias("over"),
                (F.sum(slope.cast("decimal(38,0)")).cast("double") / 1000).alias("slope"),
            )
        )
        low = F.when(F.col("over") <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("over") >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.when(F.col("slope") > 0, F.col("over") / F.col("slope"))
        # Without a bracket on one side, go twice as far that way.
        halved = (
            F.when(F.col("low").isNull(), F.col("high") - 2 * F.abs("high") - 1)
            .when(F.col("high").isNull(), F.col("low") + 2 * F.abs("low") + 1)
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (
            F.col("newton").isNotNull()
            & (F.col("low").isNull() | (F.col("newton") > F.col("low")))
            & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
            & (F.abs(F.col("newton") - F.col("tilt")) <= 2 * F.abs("tilt") + 2)
        )
        near = F.abs("over") <= ENOUGH * F.col("target")
        full = F.col("target") >= most * F.col("source_size")
        state = written(
            sums.withColumns({"newton": newton, "low": low, "high": high})
            .withColumn("done", F.col("done") | near | full)
            .withColumn(
                "tilt",
                F.when(F.col("done"), F.col("tilt"))
                .when(inside, F.col("newton"))
                .otherwise(halved),
            )
            .select("source", "mean", "target", "source_size", "tilt", "low", "high", "done"),
            "tilts",
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "mean", "tilt")


def running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all documents of the source that come before.

    Larger documents come first.  Documents of a source are in blocks of similar size,
    large ones divided by hash; the blocks' totals are summed along the source, and the
    values along each block.
    """
    block = ["source", "band", "part"]
    totals = rows.groupBy(*block).agg(F.sum(value).alias("total"))
    along = Window.partitionBy("source").orderBy(F.desc("band"), "part")
    totals = totals.select(
        *[F.col(c).alias(f"t_{c}") for c in block],
        F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    inside = (
        Window.partitionBy(*block)
        .orderBy(F.desc("size"), "key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in block]
    return (
        rows.withColumn("within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, same)
        .withColumn(name, F.col("ahead") + F.col("within"))
        .drop("within", "ahead", *[f"t_{c}" for c in block])
    )


def source_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: int = MOST,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Copies of every document, so that each source has its target of words.

    Returns the id, ``check`` (hash of the text, which tells rows with one id apart),
    ``source``, ``size`` (words; a null text has none), ``source_size``, ``target``,
    ``copies`` (whole copies after rounding) and ``taken`` (words the mix takes: the
    copies, and on the few documents that even out a source's sum, part of one more
    or less).  A null source is a source, the last.  Documents without words are never
    taken.  Repeated rows count each.  Other columns are not looked at.  An empty table
    gives no rows.
    """
    sizes = written(
        docs.select(
            row_key(id_col, text_col).alias("key"),
            F.col(source_col).alias("source"),
            words_in(F.col(text_col)).alias("size"),
        ),
        "sized",
    )
    goals = written(targets(sizes, most), "targets")
    tilt = tilts(sizes, goals, most)
    per_source = goals.join(
        tilt.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "left"
    ).select(F.col("source").alias("name"), "source_size", "target", "mean", "tilt")
    band = F.when(F.col("size") > 0, F.floor(F.log2("size") * 4)).otherwise(-1).cast("int")
    banded = sizes.withColumn("band", band)
    parts = banded.groupBy("source", "band").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("parts")
    ).select(F.col("source").alias("p_source"), F.col("band").alias("p_band"), "parts")
    rate = F.when(F.col("size") == 0, 0.0).when(
        F.col("target") >= most * F.col("source_size"), float(most)
    ).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    rated = (
        banded.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("band") == F.col("p_band")))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
        .join(per_source, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("rate", F.round(rate * UNIT).cast("bigint"))
        .drop("p_source", "p_band", "parts", "name", "mean", "tilt")
    )
    half = UNIT // 2
    summed = running(rated, "rate", "before")
    copies = F.floor((F.col("before") + F.col("rate") + half) / UNIT) - F.floor(
        (F.col("before") + half) / UNIT
    )
    rounded = written(
        summed.withColumn("copies", F.least(copies, F.lit(most)).cast("bigint")).drop("before"),
        "rounded",
    )
    short = rounded.groupBy("source").agg(
        F.first("target").alias("aim"), F.sum(F.col("copies") * F.col("size")).alias("have")
    ).select(F.col("source").alias("s_source"), (F.round("aim").cast("bigint") - F.col("have")).alias("short"))
    room = F.when(F.col("short") > 0, (most - F.col("copies")) * F.col("size")).otherwise(
        F.col("copies") * F.col("size")
    )
    evened = running(
        rounded.join(short, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("room", room),
        "room",
        "before",
    )
    change = F.least("room", F.greatest(F.abs("short") - F.col("before"), F.lit(0)))
    return evened.select(
        F.col("key.id").alias(id_col),
        F.col("key.check").alias("check"),
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size") + F.signum("short").cast("bigint") * change).cast("bigint").alias("taken"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix has whole copies of it."""
    copies = source_mix(docs, id_col, text_col).select(
        F.struct(F.col(id_col).cast("bigint").alias("id"), "check").alias("key"), "copies"
    )
    # Equal rows share a key: their numbers of copies are dealt out one by one.
    per_key = written(
        copies.groupBy("key").agg(F.sort_array(F.collect_list("copies")).alias("each")), "copies"
    )
    packed = docs.select(row_key(id_col, text_col).alias("key"), F.struct(*docs.columns).alias("row"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    return (
        packed.join(per_key, "key")
        .withColumn("turn", turn)
        .withColumn("n", F.element_at("each", F.col("turn")).cast("int"))
        .select("row", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
        .select("row.*")
    )


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    return source_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
