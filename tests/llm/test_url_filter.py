import random
from collections import Counter

import pytest

from chronoscope.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in urls], "page_id long, url string, rule string, host string").repartition(5)
    got = url_filter.judged(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), **options).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(u, rules)) for i, u in urls)


EDGES = [(1, None), (1, None), (2, ""), (3, "no scheme.com/en/"), (4, "http://"), (5, "http:///en/"), (6, "HTTP://EXAMPLE.com"), (7, "http://WWW.Example.COM/en/?x"),
         (8, "http://example.com/en"), (9, "http://notexample.com/en/"), (10, "a://b.net/es/://x"), (10, "a://b.net/es/://x"), (None, "x://net/fr/#"), (None, None), (11, "x://com?/en/"),
         (12, "x://com."), (13, "x://" + "a." * 3000 + "net/es/" + "p" * 100_000), (14, "x://É.com/\U0001f600"), (15, "x://a\nb.com/\n"), (16, "x://..com/")]


def test_edges(spark):
    check(spark, EDGES, RULES)


def test_no_rules_and_no_rows(spark):
    check(spark, EDGES, [], )
    check(spark, [], RULES)


def test_nested_rules_by_brute_force(spark):
    r = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "a.net", "aa.com", "xcom"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c/", "/b", "/é/"]
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((r.choice(hosts), r.choice(paths)) for _ in range(60))}.values())
    urls = [(i, f"http://{r.choice(['', 'w.', 'W.v.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'x', '/y', '?a/', '#b'])}") for i in range(3000)]
    urls += [(9000 + i % 7, "http://b.a.com/a/b/c/d") for i in range(2000)]  # one key with many rows: it is split over ranges
    check(spark, urls, rules)


def test_hosts_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "broadcast_if_small", lambda df, n: df)
    check(spark, EDGES, RULES)


def test_equal_rules_block(spark):
    rules = [("com", "/", "allow"), ("COM", "/", "block"), (None, "/", "block"), ("net", None, "block")]
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://net")], "page_id long, url string")
    got = url_filter.judged(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/", "block"), ("net", "block")]


@pytest.mark.parametrize("parts", [1, 40])
def test_same_for_any_number_of_ranges(spark, sf001, parts, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGES", parts)
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    got = url_filter.judged(pages, spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)).collect()
    want = [(r.page_id, *brute(r.url, RULES)) for r in pages.select("page_id", "url").collect()]
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_other_rows_of_a_rule_are_not_lost_when_dealt(spark):
    cuts = [("com.a#/b", 5), ("com.a#/b", 9), ("com.b#", 0), ("net#/", 1)]
    rules = spark.createDataFrame([("com.a#/b",), ("com.a#/",), ("com#",), ("net#/x",), ("zz#",)], "key string")
    got = {}
    for r in url_filter._dealt_rules(rules, cuts).collect():
        got.setdefault(r.key, []).append(r.part)
    assert got == {"com.a#/b": [0, 1, 2], "com.a#/": [0, 1, 2], "com#": [0], "net#/x": [4], "zz#": [4]}
