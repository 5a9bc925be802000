import re

import duckdb

from shelfcheck.llm import sql, url_rules

URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/1", "http://x.www.EXAMPLE.com/en/", "http://example.com/fr", "http://example.com", "http://notexample.com/en/",
    "http://a.net/es/1", "http://a.net/fr/x?y#z", "http://net/es/", "http://a.net/de/", "http://a.net/es", "HTTP://User@A.NET/es/q", "http://a.com:80/en/", "no scheme", "", None, "://", "http://", "x://h?q=/en/",
    "http://ads.a.org/", "http://a.org/ads/", "http://a.org/loads/", "http://a.org/x?sessionid=1", "http://10.1.2.3/", "http://a.org/file.zip?x", "http://a.org/a//b//c", "http://ünï.org/LOGIN",
    "http://a.org/login\n", "http://a.org/en/1?page=2&ref=x", "http://a.org/?utm_source=feed", "a://b://c.net/es/", "http://a.org/" + "x" * 50_000,
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_rules.LIST for h, p in [r.rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        best = max(fits, key=lambda r: len(r.rule))
        return host, path, best.rule, best.verdict
    hit = url is not None and any(url_rules.compiled(p.pattern).search(url.lower()) for p in url_rules.PATTERNS)
    return host, path, None, "block" if hit else "allow"


def test_equals_every_rule_tried(spark):
    rows = list(enumerate(URLS)) * 2
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' as host", "1 as url_verdict")
    got = [(r.page_id, *(r.url_verdict[c] for c in ("host", "path", "rule", "verdict"))) for r in url_rules.judged(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(u)) for i, u in rows], key=str)
    assert url_rules.judged(df.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(sql.url_rules(url_rules.LIST, url_rules.PATTERNS)).fetchall()
    assert len(want) == len(URLS)
    assert {r[0]: r[1:] for r in want} == {i: plain(u) for i, u in enumerate(URLS)}


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_rules.PatternRule(("aa", "bb"), "aa.*bb"), url_rules.PatternRule(("bb",), "bb"), url_rules.PatternRule((), "c")]
    assert url_rules.index(rules, {"aa": 5, "bb": 2}) == ({"bb": [0, 1]}, [2])
    assert url_rules.index(rules, {"aa": 1, "bb": 2}) == ({"aa": [0], "bb": [1]}, [2])


def test_tokens_stand_in_whatever_the_pattern_matches():
    """The index may only hide rules that can't match."""
    for rule in url_rules.PATTERNS:
        for url in filter(None, URLS + [f"http://{t}.x.org/{t}/{t}?{t}=1&p=2" for r in url_rules.PATTERNS for t in r.tokens] + ["http://a/wp-login.php", "http://a/cgi-bin/x", "http://a/viewtopic.php?p=1"]):
            if url_rules.compiled(rule.pattern).search(url.lower()):
                assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", url.lower())), (rule, url)
