import re

from lodestack.llm import url_filter
from lodestack.llm.entries import URL_RULES

URLS = [None, "", "x", "http://", "HTTP://EXAMPLE.org/es/1", "http://a.example.org/en/1", "http://a.example.org/en/2?x=/en/1", "http://notexample.org/es/", "http://org", "http://org/", "http://b.com/fr/1#y", "http://com/de/", "http://b.com/FR/", "http://u://v.org/z", "http://É.org/ü", "http://a..org/q", "x" * 9000 + "://k.org/" + "p" * 9000]


def brute(url, rules, default):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    out = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], [x for x in rules if x[0] and x[2]], "allow"), r


def test_edges_and_repeats(spark):
    judge(spark, URLS * 2, URL_RULES)


def test_nested_rules_need_the_stack(spark):
    rules = [("a.b", "/", "block"), ("a.b", "/x", "allow"), ("a.b", "/x/y", "block"), ("b", "/x/y/z", "allow"), ("b", "", "block"), (None, "/", "block"), ("", "/", "block")]
    judge(spark, [f"http://{h}{p}" for h in ("a.b", "b", "c.a.b", "z") for p in ("", "/", "/w", "/x", "/x/", "/x/y", "/x/y/z", "/x/z", "/xy", "/y")], rules)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(none, rules).count() == 0
    one = spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge_urls(one, rules.limit(0)).first().asDict() == {"page_id": None, "host": "a.org", "path": "/", "rule": None, "verdict": "allow"}
