import re

import pytest

from waymark.llm import url_filter as uf

CASES = {
    "http://A.Example.ORG/en/123": ("a.example.org", "/en/123", "example.org/en/1", "block"),
    "http://example.org/en/2?x=casino": ("example.org", "/en/2", "org/", "allow"),
    "http://org": ("org", "", None, "allow"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://x.example.org/es/9#casino": ("x.example.org", "/es/9", "example.org/es/", "block"),
    "http://a.com/de/1": ("a.com", "/de/1", "com/de/", "block"),
    "http://a.com/fr/casino": ("a.com", "/fr/casino", "com/fr/", "allow"),
    "http://a.com/DE/1": ("a.com", "/DE/1", None, "allow"),
    "http://a.net/Casino": ("a.net", "/Casino", None, "block"),
    "http://a.net/casinos": ("a.net", "/casinos", None, "allow"),
    "http://a.net/free": ("a.net", "/free", None, "allow"),
    "http://a.net/free-free/free": ("a.net", "/free-free/free", None, "allow"),
    "http://free.net/win": ("free.net", "/win", None, "block"),
    "http://u@h.net:80?q=1/2": ("u@h.net:80", "", None, "allow"),
    "no scheme casino": ("", "", None, "block"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
}


def brute_hits(url, terms):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    return [t for t in terms for _ in re.finditer(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)]


def test_cases(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(CASES)] + [(0, next(iter(CASES)), "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    found = uf.judged(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.url], r.url
        words = uf.Vocabulary()
        assert r.strict_hits == len(brute_hits(r.url, words.strict))
        assert r.soft_terms == len(set(brute_hits(r.url, words.soft)))
    assert uf.judged(pages.limit(0)).collect() == []


def test_terms_inside_each_other(spark):
    words = uf.Vocabulary(strict=("a b",), soft=("a", "b", "ab"), enough=2)
    urls = spark.createDataFrame([(1, "x://h/ab"), (2, "x://h/a-b"), (3, "x://h/a b"), (4, "x://h/" + "a/" * 50_000)], "page_id long, url string")
    found = {r.page_id: (r.verdict, r.strict_hits, r.soft_terms) for r in uf.judged(urls, (), words).collect()}
    assert found == {1: ("allow", 0, 1), 2: ("block", 0, 2), 3: ("block", 1, 2), 4: ("allow", 0, 1)}


def test_vocabulary_from_a_table(spark):
    rows = [("Casino", "strict"), ("free", "soft"), ("free", "soft"), ("win", "soft"), (None, "soft"), ("", "strict")]
    words = uf.vocabulary_of(spark.createDataFrame(rows, "term string, kind string"))
    assert words == uf.Vocabulary(("casino",), ("free", "win"), 2)
    with pytest.raises(ValueError, match="more than 1"):
        uf.vocabulary_of(spark.createDataFrame(rows, "term string, kind string"), most=1)
    for bad in [("a-b", "soft"), ("a", "odd")]:
        with pytest.raises(ValueError, match="another kind"):
            uf.vocabulary_of(spark.createDataFrame([bad], "term string, kind string"))


def test_clashing_names_and_long_urls_pass(spark):
    rows = [(1, "http://a.com/casino", "keep", 7), (2, "http://a.com/" + "x" * 300_000, "keep", 8), (3, "", None, None)]
    found = uf.judged(spark.createDataFrame(rows, "page_id long, url string, _rule string, soft_terms long")).orderBy("page_id").collect()
    assert [(r._rule, r.verdict, r.soft_terms) for r in found] == [("keep", "block", 0), ("keep", "allow", 0), (None, "allow", 0)]
