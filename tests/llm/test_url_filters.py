"""URL rules: given ones by hand, mined ones against every combination counted."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakehaul.llm.url_filters import RULES, mined_rules, op13_url_filters, url_filter
from tests.conftest import DATA

SCHEMA = "page_id bigint, url string, html string, host string, rule string, token int"


def judged(spark, urls, **more):
    rows = [(i, u, "h", "x", "y", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.page_id: r for r in url_filter(pages, **more).collect()}


def by_hand(url):
    """Host, path and rule of one URL."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for _, rule in RULES:
        of_host, of_path = rule.split("/", 1)
        if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "://", "http://net", "http://net/", "http://A.NET/x?y#z", "http://anet/",
    "http://example.net/en/1", "http://www.Example.net/en/", "http://example.net/en", "http://example.net/EN/",
    "http://badexample.net/en/", "http://example.com/de/?a=b", "http://example.com/de", "http://x.example.com/de/x",
    "http://a.org/fr/x", "http://org/fr/", "http://a.org?q=/fr/", "http://a.org#/fr/", "http://ÄÖ.Org/fr/ß",
    "http://net/://org/fr/", "ftp://a://b/c", "http://x.net\n/fr", "http://a.org/fr/\n?x", "http:///net/",
    "http://" + "a." * 5000 + "net/" + "b/" * 5000, "http://user@net/", "http://net:80/",
]


def test_host_path_and_rule(spark):
    found = judged(spark, URLS + URLS[:5])
    for i, url in enumerate(URLS + URLS[:5]):
        assert (found[i].host, found[i].path, found[i].rule) == by_hand(url), url
        given = dict((rule, verdict) for verdict, rule in RULES).get(found[i].rule)
        assert found[i].verdict == (given or found[i].verdict) and found[i].verdict in ("allow", "block")


def test_an_empty_table_and_one_without_labelled_urls(spark):
    assert judged(spark, []) == {}
    assert {r.verdict for r in judged(spark, ["http://a.com/x", None]).values()} == {"allow"}
    assert {r.verdict for r in judged(spark, ["http://a.com/x"], default="block").values()} == {"block"}


def every_rule(transactions, min_support, min_confidence):
    """All combinations of tokens, counted one by one."""
    whole, with_verdict = Counter(), Counter()
    for tokens, verdict in transactions:
        for n in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), n):
                whole[some] += 1
                with_verdict[some, verdict] += 1
    rules = {
        (some, verdict): (n / whole[some], n / len(transactions))
        for (some, verdict), n in with_verdict.items()
        if n >= min_support * len(transactions) and n / whole[some] >= min_confidence
    }
    return {
        key: value
        for key, value in rules.items()
        if not any(
            rules.get((tuple(t for t in key[0] if t != one), key[1]), (0,))[0] >= value[0] for one in key[0]
        )
    }


TRANSACTIONS = (
    [(("a", "b"), "block")] * 9 + [(("a", "c"), "allow")] * 8 + [(("b", "c"), "allow")] * 7
    + [(("a", "b", "c"), "block")] * 5 + [(("c",), "allow")] * 3 + [(("a",), "block")] * 2 + [((), "block")]
    + [(("a", "b", "d"), "allow")] * 4
)


@pytest.mark.parametrize("support, confidence", [(0.05, 0.6), (0.1, 0.8), (0.02, 0.5), (0.15, 0.7)])
def test_mined_rules_are_those_of_all_combinations(spark, support, confidence):
    labelled = spark.createDataFrame([(list(t), v) for t, v in TRANSACTIONS], "tokens array<string>, verdict string")
    rows = mined_rules(labelled.repartition(4), support, confidence, max_tokens=100).collect()
    got = {(tuple(sorted(r.tokens)), r.verdict): (r.confidence, r.support) for r in rows}
    want = every_rule(TRANSACTIONS, support, confidence)
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    alone = Counter(t for tokens, _ in TRANSACTIONS for t in tokens)
    assert all(alone[r.key] == min(alone[t] for t in r.tokens) for r in rows)


def test_a_combination_decides_where_no_token_does(spark):
    """Tokens x and y stand in allowed and blocked URLs alike, together only in blocked ones."""
    urls = [f"http://s{i % 3}.net/x/y" for i in range(30)] + [f"http://s{i % 3}.example.net/en/x/q" for i in range(30)]
    urls += [f"http://s{i % 3}.example.net/en/y/q" for i in range(30)] + [f"http://s{i % 3}.net/en/x" for i in range(6)]
    urls += [f"http://s{i % 3}.net/en/y" for i in range(6)] + [f"http://s{i % 3}.example.net/en/q" for i in range(6)]
    ask = ["http://other.com/x/y", "http://other.com/x/q", "http://other.com/y/q", "http://other.com/z"]
    found = judged(spark, urls + ask, min_support=0.01)
    assert [found[len(urls) + i].verdict for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert found[len(urls) + 3].mined_tokens is None and found[len(urls)].mined_tokens is not None


def test_held_out_labelled_urls_are_judged_as_their_rules_do(spark):
    """Rules for half of the hosts are withdrawn; what is mined has to stand in for them."""
    pages = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/pages.parquet")
    whole = url_filter(pages).where("rule IS NOT NULL").select("page_id", F.col("verdict").alias("want"))
    fewer = [r for r in RULES if r[1] != "example.com/de/"]
    got = url_filter(pages, fewer).where("rule IS NULL").select("page_id", "verdict", "confidence")
    both = whole.join(got, "page_id")
    right = both.where("want = verdict").count() / both.count()
    assert both.count() > 50 and right > 0.9


def test_query(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = op13_url_filters(spark, DATA)
    assert rows.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    urls = {r.page_id: r.url for r in pages.collect()}
    got = rows.collect()
    assert len(got) == len(urls)
    assert all((r.host, r.path, r.rule) == by_hand(urls[r.page_id]) for r in got)


def test_rules_of_urls_with_more_than_ten_frequent_tokens(spark):
    """All combinations count, however many tokens the URLs have."""
    words = "abcdefghijklm"
    rows = [(tuple(w for k, w in enumerate(words) if (i * (k + 3)) % 13 > 1), "block" if i % 3 else "allow") for i in range(26)]
    assert max(len(tokens) for tokens, _ in rows) > 10
    labelled = spark.createDataFrame([(list(t), v) for t, v in rows], "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in mined_rules(labelled.repartition(3), 0.1, 0.7).collect()}
    want = every_rule(rows, 0.1, 0.7)
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_tokens_of_the_same_urls_are_not_combined(spark):
    """Sixty words in allowed and blocked URLs alike would have 2^60 combinations."""
    path = "/".join(f"w{i}" for i in range(60))
    urls = [f"http://s.net/{path}"] * 3 + [f"http://s.example.net/en/{path}"] + ["http://t.example.net/en/x"] * 2
    found = judged(spark, [*urls, "http://other.com/w7/w30", "http://other.com/y"], min_confidence=0.7)
    assert (found[6].verdict, found[6].mined_tokens, found[6].confidence) == ("block", "path=w7", 0.75)
    assert found[7].mined_tokens is None
