import re
from itertools import combinations

from pyspark.sql import functions as F

from locuspark.llm.registry import URL_RULES
from locuspark.llm.url_rules import BAD, judge_urls, matched, mine


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for says, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (says, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme", "http://Example.COM/en/1", "https://www.example.com/en/2?x#y", "http://a.b.net/es/", "http://net/fr/x", "http://x.net/de/", "http://x.org/en/", "http://com", "http://com/", "http://notexample.com/en/", "http://a.com?/en/", "http://example.com#/en/", "x://y://z.com/", "http://İ.com/", "http://example.com/EN/", "http://spam.org/buy/1", "http://a.com/\n/x", "http:///en/", "http://long.org/" + "a/" * 30_000]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[3], "x", 1), (3, URLS[3], "x", 1)], "page_id long, url string, host string, rule int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judge_urls(pages, labels, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[3] if r.page_id is None else URLS[r.page_id]
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), url
    assert judge_urls(pages.limit(0), labels, URL_RULES).collect() == []


def test_mined_rules(spark):
    rows = [["a", "b", "c"] + [BAD]] * 6 + [["a", "c"]] * 6 + [["b", "d"]] * 5 + [["d", BAD]] * 5 + [["e", BAD]] * 9 + [["e"]]
    items = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    index = mine(items, support=0.1, confidence=0.8)
    got = [r.rule for r in index.collect()]
    n, want = len(rows), []
    for k in (1, 2, 3):
        for s in combinations("abcde", k):
            has = [r for r in rows if set(s) <= set(r)]
            bad = sum(BAD in r for r in has)
            if has and bad / n >= 0.1 and bad / len(has) >= 0.8 and not any(set(w) <= set(s) for w in want):
                want.append(list(s))
    assert sorted(got) == sorted(want) and want
    hit = [r["items"] for r in matched(items, index).collect()]
    assert sorted(hit) == sorted(map(list, {tuple(r) for r in rows if any(set(w) <= set(r) for w in want)}))
    assert mine(items.limit(0)).collect() == []


def test_more_rules_than_any_list_holds(spark):
    """Twenty thousand rules: each matches its own urls, and no others; none is cut off."""
    n = 20_000
    index = spark.range(n).select(F.array(F.lit("common"), F.concat(F.lit("t"), F.col("id"))).alias("rule"), F.concat(F.lit("t"), F.col("id")).alias("token"))
    sets = spark.range(2 * n).select(F.array(F.lit("common"), F.concat(F.lit("t"), F.col("id")), F.lit("x")).alias("items"))
    got = matched(sets, index).select(F.expr("cast(substring(items[1], 2) as long)").alias("i"))
    assert got.agg(F.count("i"), F.max("i"), F.min("i")).first()[:] == (n, n - 1, 0)


def test_a_rule_needs_enough_pages(spark):
    pages = spark.createDataFrame([(str(i), f"http://h{i}.org/a/{'x' if i < 4 else 'y'}") for i in range(40)], "page_id string, url string")
    labels = spark.createDataFrame([(i, 0 if i < 4 else 1, None) for i in range(40)], "doc_id long, quality int, toxic int")
    judged = lambda least: {int(r.page_id) for r in judge_urls(pages, labels, [], least=least).collect() if r.mined}
    assert judged(4) == {0, 1, 2, 3} and judged(5) == set()


def test_mined_verdict(spark):
    pages = spark.createDataFrame([(i, f"http://shop{i % 5}.org/{'buy' if i % 2 else 'read'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, None) for i in range(100)] + [(None, 0, 0), (150, None, None)], "doc_id long, quality int, toxic int")
    got = judge_urls(pages, labels, URL_RULES).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") and r.rule is None for r in got)
