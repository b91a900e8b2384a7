"""URL filters: given rules first, mined association rules for the rest.

1. A given rule is a host and the beginning of a path.  It fits its host and all subdomains;
   the longest that fits decides.
2. The URLs that a rule decides are the labelled ones.  Each becomes a transaction of tokens
   (scheme, host labels, words of the path, query names, fragment) and its verdict, and Spark's
   FP-growth mines the combinations that are frequent among them.
3. A combination of tokens with a verdict is a mined rule: its support is their share of the
   labelled URLs, its confidence the share of the verdict among those with the tokens.  Rules
   below ``MIN_CONFIDENCE`` go, and so do rules that with one token less are at least as
   confident, since they can decide nothing.
4. The rules are indexed by their rarest token.  A URL without a given rule looks up its tokens
   there, a rule that it holds whole counts, and the most confident one decides (then the
   best supported, the longest, the last by its tokens).  A URL that no rule fits is allowed.

Statistics are those of all labelled URLs with all their frequent tokens.  A token is
frequent from ``MIN_SUPPORT`` of the labelled URLs on, so on average there are as many as a URL
has tokens, by ``MIN_SUPPORT``.  What cannot give a rule that stays is not combined:

* Tokens of the same URLs are one *class*, named by its least token, and any of them stands
  for it: two of them in a combination add nothing to one.  A rule is kept by classes.
* A token that all labelled URLs have adds nothing either.
* A token with one verdict only is a rule of full confidence, which no combination exceeds.

Combinations of all other classes of a URL are mined, however many: the work grows with
the number of frequent ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehaul.llm.shared import written

#: Of all labelled URLs, of the URLs with a rule's tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8

BLOCK, ALLOW = "block", "allow"
#: The given rules, as host and path.
RULES = [(BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items of the miner that are verdicts; no token begins so.
VERDICT = "verdict="


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct of ``rule`` and ``verdict``, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, _, of_path = rule.partition("/")
        fits = (host == of_host) | F.endswith(host, F.lit(f".{of_host}"))
        fits &= F.startswith(path, F.lit(f"/{of_path}"))
        answer = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, answer).otherwise(found)
    return found


def tokens_of(url: Column, rest: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, each with the kind of its place; none without a host part."""
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda pair: F.split(pair, "=", 2)[0])
    fragment = F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1)
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    kinds = {
        "scheme": F.array(scheme),
        "host": F.split(host, r"\."),
        "path": F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"),
        "query": names,
        "fragment": F.array(fragment),
    }

    def marked(kind: str) -> Callable[[Column], Column]:
        return lambda word: F.concat(F.lit(f"{kind}="), word)

    each = [
        F.transform(F.filter(words, lambda w: w != ""), marked(kind)) for kind, words in kinds.items()
    ]
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*each)))


def token_classes(labelled: DataFrame, least: int, urls: int) -> DataFrame:
    """Every frequent ``token`` with its ``class``, number of ``urls`` and of ``blocked`` ones,
    and whether combinations with it can give rules (``mixed``).

    Tokens are of one class if as many URLs, and the same ones by two sums of 64-bit hashes, have them.
    """
    blocked = (F.col("verdict") == BLOCK).cast("long")
    sums = [F.sum(F.xxhash64(F.lit(seed), "url_no").cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    counted = (
        labelled.select("url_no", F.explode("tokens").alias("token"), blocked.alias("blocked"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("urls"), F.sum("blocked").alias("blocked"), *sums)
        .where(F.col("urls") >= least)
    )
    counted = written(counted, "tokens")
    same = ["urls", "blocked", "sum1", "sum2"]
    names = counted.groupBy(*same).agg(F.min("token").alias("class"))
    mixed = (F.col("urls") < urls) & (F.col("blocked") > 0) & (F.col("blocked") < F.col("urls"))
    return written(
        counted.join(names, same).select("token", "class", "urls", "blocked", mixed.alias("mixed")), "token-classes"
    )


RULE = "key string, tokens array<string>, verdict string, confidence double, support double"


def combined(labelled: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Frequent sets of two and more mixed classes (``tokens``): ``verdict`` (null: any) and ``freq``."""
    spark = labelled.sparkSession
    names = classes.where("mixed AND token = class").select("class")
    transactions = written(
        labelled.select("url_no", "verdict", F.explode("tokens").alias("class"))
        .join(F.broadcast(names), "class")
        .groupBy("url_no")
        .agg(F.collect_list("class").alias("classes"), F.first("verdict").alias("verdict"))
        .where(F.size("classes") > 1)
        .select(F.array_append("classes", F.concat(F.lit(VERDICT), "verdict")).alias("items")),
        "transactions",
    )
    rows = transactions.count()
    if rows < least:
        return spark.createDataFrame([], "tokens array<string>, verdict string, freq bigint")
    # Rounding must not lift the threshold over a whole number of URLs.
    miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows)
    verdict = F.get(F.filter("items", lambda t: t.startswith(VERDICT)), F.lit(0))
    return (
        miner.fit(transactions)
        .freqItemsets.withColumn("tokens", F.array_sort(F.filter("items", lambda t: ~t.startswith(VERDICT))))
        .withColumn("verdict", verdict)
        .where(F.size("tokens") > 1)
        .select("tokens", F.expr(f"substring(verdict, {len(VERDICT) + 1})").alias("verdict"), "freq")
    )


def class_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """Classes of tokens, and association rules from classes (``tokens``) to ``verdict`` with
    the class they are indexed by (``key``); nothing if no token is frequent."""
    labelled = written(
        labelled.select(F.monotonically_increasing_id().alias("url_no"), "tokens", "verdict"), "labelled-urls"
    )
    total = labelled.agg(F.count(F.lit(1)).alias("urls"), F.sum(F.size("tokens")).alias("tokens")).first()
    if not total["urls"] or not total["tokens"]:
        return None
    urls = total["urls"]
    least = max(math.ceil(min_support * urls), math.ceil(total["tokens"] / max_tokens) if max_tokens else 1, 1)
    classes = token_classes(labelled, least, urls)
    single = classes.where("token = class").select(
        F.array("class").alias("tokens"),
        F.explode(
            F.array(
                F.struct(F.lit(None).cast("string").alias("verdict"), F.col("urls").alias("freq")),
                F.struct(F.lit(BLOCK).alias("verdict"), F.col("blocked").alias("freq")),
                F.struct(F.lit(ALLOW).alias("verdict"), (F.col("urls") - F.col("blocked")).alias("freq")),
            )
        ).alias("of"),
    )
    single = single.select("tokens", "of.verdict", "of.freq").where(F.col("freq") >= least)
    sets = written(single.unionByName(combined(labelled, classes, least)), "itemsets")
    whole = sets.where("verdict IS NULL").select("tokens", F.col("freq").alias("urls"))
    rules = (
        sets.where("verdict IS NOT NULL")
        .join(whole, "tokens")
        .withColumn("confidence", F.col("freq") / F.col("urls"))
        .where(F.col("confidence") >= min_confidence)
        .withColumn("support", F.col("freq") / urls)
    )
    rules = written(rules.select("tokens", "verdict", "confidence", "support"), "rules")
    shorter = (
        rules.where(F.size("tokens") > 1)
        .select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
        .select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("token")).alias("fewer"))
        .join(
            rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("before")),
            ["fewer", "verdict"],
        )
        .where("before >= confidence")
        .select("tokens", "verdict")
        .distinct()
    )
    keys = (
        rules.select("tokens", F.explode("tokens").alias("class"))
        .distinct()
        .join(classes.where("token = class").select("class", "urls"), "class")
        .groupBy("tokens")
        .agg(F.min(F.struct("urls", "class"))["class"].alias("key"))
    )
    kept = rules.join(shorter, ["tokens", "verdict"], "left_anti").join(keys, "tokens")
    return classes, written(kept.select("key", "tokens", "verdict", "confidence", "support"), "url-rules")


def mined_rules(labelled: DataFrame, *args, **mining) -> DataFrame:
    """Association rules from ``tokens`` to ``verdict``, with the token they are indexed by.

    A rule for each token of its classes.
    """
    found = class_rules(labelled, *args, **mining)
    if found is None:
        return labelled.sparkSession.createDataFrame([], RULE)
    classes, rules = found
    members = classes.groupBy("class").agg(F.collect_list("token").alias("members"))
    chosen = (
        rules.withColumn("rule", F.monotonically_increasing_id())
        .select("rule", "key", F.explode("tokens").alias("class"))
        .join(members, "class")
        .groupBy("rule", "key")
        .agg(F.collect_list(F.struct("class", "members")).alias("of"))
    )
    one = F.array(F.struct(F.array().cast("array<string>").alias("tokens"), F.lit("").alias("at_key")))

    def more(done, of):
        return F.flatten(
            F.transform(
                done,
                lambda d: F.transform(
                    of["members"],
                    lambda token: F.struct(
                        F.array_append(d["tokens"], token).alias("tokens"),
                        F.when(of["class"] == F.col("key"), token).otherwise(d["at_key"]).alias("at_key"),
                    ),
                ),
            )
        )

    sets = chosen.select("rule", F.explode(F.aggregate("of", one, more)).alias("set"))
    return (
        rules.withColumn("rule", F.monotonically_increasing_id())
        .drop("key", "tokens")
        .join(sets, "rule")
        .select(F.col("set.at_key").alias("key"), F.array_sort("set.tokens").alias("tokens"), "verdict", "confidence", "support")
    )


def best_rules(urls: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """For each ``row_no`` the rule that decides it, if any fits.

    Of the tokens of a class, the last that the URL has stands for it.
    """
    used = rules.select(F.explode("tokens").alias("class")).distinct()
    known = classes.join(used, "class").select("token", "class")
    held = (
        urls.select("row_no", F.explode("tokens").alias("token"))
        .join(F.broadcast(known), "token")
        .groupBy("row_no", "class")
        .agg(F.max("token").alias("token"))
        .groupBy("row_no")
        .agg(F.map_from_entries(F.collect_list(F.struct("class", "token"))).alias("held"))
    )
    rules = rules.select("key", F.col("tokens").alias("needs"), "verdict", "confidence", "support")
    tokens = F.array_sort(F.transform("needs", lambda name: F.element_at("held", name)))
    return (
        held.select("row_no", "held", F.explode(F.map_keys("held")).alias("key"))
        .join(rules, "key")
        .where(F.size(F.array_except("needs", F.map_keys("held"))) == 0)
        .withColumn("tokens", tokens)
        .groupBy("row_no")
        .agg(F.max(F.struct("confidence", "support", F.size("tokens").alias("size"), "tokens", "verdict")).alias("found"))
        .select("row_no", F.struct("found.verdict", "found.tokens", "found.confidence").alias("found"))
    )


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
    **mining,
) -> DataFrame:
    """A verdict for every row of ``pages``.

    Returns the id column, ``host`` (A-Z lower-cased), ``path``, ``rule`` (the given one, or
    null), ``verdict`` (``block`` or ``allow``), and for a verdict by a mined rule its
    ``mined_tokens`` and ``confidence``.  A URL that is null or has no ``://`` has an empty host
    and path and gets ``default``, as does one that no rule fits.  Of given rules of one length
    the last in order fits first.  Repeated rows and ids are judged row by row and each counts
    as a labelled URL; without labelled URLs nothing is mined.  Texts count whole, however long;
    an empty table gives no rows; other columns are not looked at.
    """
    url = F.col(url_col)
    rest = after_scheme(url)
    judged = written(
        pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(rest, F.lit("")).alias("rest"))
        .withColumn("host", host_of(F.col("rest")))
        .withColumn("path", path_of(F.col("rest")))
        .withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
        .select(
            F.monotonically_increasing_id().alias("row_no"), "page_id", "host", "path", "given.rule", "given.verdict",
            tokens_of(F.col("url"), F.col("rest"), F.col("host"), F.col("path")).alias("tokens"),
        ),
        "judged-urls",
    )
    mined = class_rules(judged.where("rule IS NOT NULL"), **mining)
    if mined is None:
        nothing = "row_no bigint, found struct<verdict:string,tokens:array<string>,confidence:double>"
        found = pages.sparkSession.createDataFrame([], nothing)
    else:
        found = best_rules(judged.where("rule IS NULL"), *mined)
    return judged.join(found, "row_no", "left").select(
        F.col("page_id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", "found.verdict", F.lit(default)).alias("verdict"),
        F.array_join("found.tokens", " ").alias("mined_tokens"),
        F.col("found.confidence").alias("confidence"),
    )


def op13_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
