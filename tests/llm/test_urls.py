import itertools
import random
import re
import time

import pytest

from trellium.llm import urls
from trellium.llm.queries import LIST, QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, rest = re.fullmatch(r"([^/?#]*)(.*)", url[url.index("://") + 3 :], re.S).groups()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest).group()


def brute(url):
    host, path = parts(url)
    fits = [r for r in LIST if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org", "http://a.example.org/en/12",
    "http://x.com/fr/", "http://x.com?/fr/", "http://com/de/", "http://notcom/de/", "https://ÄB.example.org/en/2#/es/", "x://y://z/fr/",
    "http://u.com/de/1\n2?x", "http://example.org/es/", "http://example.org/es/",
]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "n") for i, u in enumerate(URLS)] + [(None, URLS[4], "n")], "page_id long, url string, host string")
    nothing = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = urls.judge(pages, LIST, nothing).collect()
    expected = [(i, *brute(u)[:3], brute(u)[3] or "allow") for i, u in [*enumerate(URLS), (None, URLS[4])]]
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(map(repr, expected))
    assert urls.judge(pages.limit(0), LIST, nothing).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Bad where casino and a ref field meet; each alone is not."""
    rows = []
    for i in range(60):
        rows.append((f"http://casino{'x' * (i % 3)}.casino.net/p/{i}?ref=1", True))
        rows.append((f"http://casino.net/p/{i}?page=2", False))
        rows.append((f"http://news{i % 5}.net/p/{i}?ref=1", False))
    return spark.createDataFrame([*rows, (None, True), ("http://a.b/", None)], "url string, bad boolean")


def combinations(mined):
    """Every combination of one token of each list."""
    return [(set(c), r.confidence) for r in mined.collect() for c in itertools.product(*r.antecedent)]


def test_mined_rules_and_index_equal_brute_force(spark, labelled):
    mined = urls.mine(labelled, min_support=0.05, min_confidence=0.9)
    rules = combinations(mined)
    assert rules and all(c >= 0.9 for _, c in rules)
    for tokens, confidence in rules:
        assert not any(t < tokens and c >= confidence for t, c in rules)
    pages = spark.createDataFrame(
        [(1, "http://casino.net/q?ref=5"), (2, "http://casino.net/q?page=5"), (3, "http://news1.net/q?ref=5"), (4, None)], "page_id long, url string"
    )
    found = {r.page_id: set(r.t) for r in pages.select("page_id", urls.tokens(pages.url).alias("t")).collect() if r.t}
    got = {r.page_id: r for r in urls.judge(pages, (), mined).collect()}
    for page, row in got.items():
        n = sum(1 for t, _ in rules if t <= found.get(page, set()))
        assert row.n_rules == n and row.verdict == ("block" if n else "allow")
    assert got[1].verdict == "block" and got[2].verdict == got[3].verdict == got[4].verdict == "allow"


def test_no_rule_is_dropped_however_many(spark):
    """Two rules for each of 5,001 bad hosts, 11 pages each."""
    bad = spark.range(5001 * 11).selectExpr("concat('://h', id div 11) as url", "true as bad")
    mined = urls.mine(bad, min_support=0.0)
    assert mined.count() == 5001 and len(combinations(mined)) == 2 * 5001
    pages = spark.range(5001).selectExpr("id as page_id", "concat('://h', id) as url")
    got = urls.judge(pages, (), mined).groupBy("verdict", "n_rules").count().collect()
    assert [tuple(r) for r in got] == [("block", 2, 5001)]


def test_templates_of_many_tokens(spark):
    """Two URLs of 25 tokens and some, of which one is bad: their tokens are three items, not 2^25 combinations."""
    both = "/".join(f"part{chr(97 + i)}" for i in range(20))
    rows = [(f"http://bad.site.net/{both}/worse?spam=1&x=2", True), (f"http://good.site.net/{both}/better?page=1&x=2", False)] * 60
    start = time.time()
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"), min_support=0.002, min_confidence=0.6)
    found = mined.collect()
    assert time.time() - start < 60
    assert [sorted(c) for r in found for c in r.antecedent] == [["field=spam", "host=bad.site.net", "hostpart=bad", "path=worse"]]
    pages = spark.createDataFrame([(1, "ftp://x.y/worse?spam=2"), (2, f"http://site.net/{both}?x=2"), (3, None), (3, None)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict, r.n_rules) for r in urls.judge(pages, (), mined).collect())
    assert got == [(1, "block", 2), (2, "allow", 0), (3, "allow", 0), (3, "allow", 0)]


def test_classes_keep_all_minimal_rules(spark):
    """Against all token sets of each labelled URL."""
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        parts = [w for w in "abcde" if rng.random() < 0.5]
        parts += ["twin", "pair"] * (rng.random() < 0.4)
        rows.append((f"http://h.net/{'/'.join(parts)}", ("a" in parts and "twin" in parts) or rng.random() < 0.1))
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = [set(r.t) for r in frame.select(urls.tokens(frame.url).alias("t")).collect()]
    labels = [b for _, b in rows]
    counts = {}
    for have, bad in zip(tokens, labels):
        for k in range(1, len(have) + 1):
            for c in itertools.combinations(sorted(have), k):
                n, m = counts.get(c, (0, 0))
                counts[c] = (n + 1, m + bad)
    rules = {frozenset(c): m / n for c, (n, m) in counts.items() if m >= 15 and m / n >= 0.6}
    minimal = {c: p for c, p in rules.items() if not any(d < c and q >= p for d, q in rules.items())}
    got = {frozenset(c): p for c, p in combinations(urls.mine(frame, min_support=0.1, min_confidence=0.6))}
    assert got.keys() == minimal.keys() and minimal
    assert all(abs(got[c] - minimal[c]) < 1e-12 for c in got)


def test_columns_named_like_helpers(spark):
    pages = spark.createDataFrame([(1, "http://a.com/fr/x", "z", 5)], "page_id long, url string, address string, id int")
    nothing = urls.mine(spark.createDataFrame([], "url string, bad boolean"))
    assert [(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, LIST, nothing).collect()] == [(1, "com/fr/", "allow")]


def test_query(spark, sf):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_urls"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(rows[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op5_urls"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if n in plan]
