"""URL filter: rules and terms against a plain walk over hand-made and awkward URLs."""

import re

import pytest

from lintlake.llm.urls import LIMIT, RULES, SOFT, STRICT, VOCABULARY, UrlRule, judged


def plain(url, rules=RULES, vocabulary=VOCABULARY):
    """host, path, rule, verdict by string methods and one search a term."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), re.split("[?#]", rest[cut:])[0]
    fits = [(len(r.host + r.path), r.verdict, r.host + r.path) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    weight = sum(w for t, w in vocabulary.items() if re.search(rf"(?<![a-z0-9\u0080-\U0010ffff]){re.escape(t)}(?![a-z0-9\u0080-\U0010ffff])", low))
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict, weight
    return host, path, None, "block" if weight >= LIMIT else "allow", weight


URLS = [
    None, "", "no scheme casino", "http://", "http:///en/1", "https://EXAMPLE.org/en/1?x", "http://a.example.org/en/2", "http://a.example.org/es/", "http://example.org", "http://badexample.org/es/x",
    "http://x.com/fr/casino-xxx", "http://x.com/de/", "http://x.com/en/", "http://org/", "http://b.org:80/es/", "http://x.net/casino", "http://x.net/casinos", "http://casino.x.net", "http://x.net/free", "http://x.net/free/free/FREE",
    "http://x.net/free/bets", "http://x.net/?q=free&r=win#top", "http://a://b.org/es/1", "http://x.net/caf\u00e9free-win", "http://x.net/\u00e9free win", "http://x.net/xxx", "http://x.net/xxxx", "http://x.net/0xxx", "http://x.net#/../es/", "ftp://h?p/q", "x" * 200_000 + "://casino",
    "http://EXAMPLE.ORG/ES/", "http://x.net/ad\nults spam", "http://example.org/en/1",
]


@pytest.fixture(scope="module")
def got(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string, rule string, verdict string")
    return {r.page_id: r for r in judged(pages.repartition(3)).collect()}


def test_every_url_as_by_a_plain_walk(got):
    for i, url in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict, r.weight) == plain(url), url
        assert r.weight == LIMIT * r.strict + r.soft


def test_hand_made_verdicts(got):
    by = {u: got[i] for i, u in enumerate(URLS)}
    assert [by[u].verdict for u in ("http://x.net/casino", "http://x.net/casinos", "http://x.net/free/free/FREE", "http://x.net/free/bets", "http://a.example.org/es/", "http://x.com/fr/casino-xxx")] == ["block", "allow", "allow", "block", "block", "allow"]
    assert by["https://EXAMPLE.org/en/1?x"].rule == "example.org/en/1" and by["http://a.example.org/en/2"].rule == "org/" and by["http://badexample.org/es/x"].rule == "org/" and by["http://b.org:80/es/"].rule is None


def test_own_rules_and_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.b/p"), (1, "http://a.b/p"), (None, "http://a.b/q"), (2, "x she hers his")], "page_id long, url string")
    rules, words = (UrlRule("a.b", "/p", "allow"), UrlRule("b", "/p", "block"), UrlRule("b", "/p", "allow")), {"he": 1, "she": 1, "hers": 1, "his": 3, "": 9}
    rows = sorted(judged(pages, rules, words).collect(), key=lambda r: (r.page_id or 0, r.verdict))
    assert [(r.page_id, r.rule, r.verdict, r.weight) for r in rows] == [(None, None, "allow", 0), (1, "a.b/p", "allow", 0), (1, "a.b/p", "allow", 0), (2, None, "block", 5)]
    tie = judged(pages, rules[1:], {}).where("page_id = 1").first()
    assert (tie.rule, tie.verdict) == ("b/p", "block")
    assert [r.verdict for r in judged(pages, (), {}).collect()] == ["allow"] * 4


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_terms_are_distinct():
    assert not set(STRICT) & set(SOFT)
