import random

import pytest

from tierflow.llm.url_filter import RULES, bloom_blocks, canonical_url, judge_urls, junk_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path, rules):
    best = None
    for verdict, rule_host, rule_path in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = rule_host + rule_path, verdict
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/en/12", "https://a.example.org/es/x?y#z",
    "http://notexample.org/es/1", "ftp://x.com/de/", "http://x.com/fr/#f", "x://y://z/de/", "http://É.com/de/é",
    "http://a.net/p?utm_source=f&b=2&a=1", "http://a.net/p/?a=1&b=2", "http://a.net?", "http://a\nb.net/p", "http://a.net/" + "x" * 20000,
]


@pytest.mark.parametrize("max_blocks", [1, 1 << 17])
def test_against_plain_loop(spark, max_blocks):
    rng = random.Random(2)
    urls = [*URLS, *(f"http://h{rng.randint(0, 30)}.net/{rng.randint(0, 30)}" for _ in range(500))]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    frame = frame.unionAll(frame.filter("page_id < 3"))
    bad = [None, "nothing", "http://h1.net/4", "https://h2.net/5/#x", "ftp://a.net/p?b=2&a=1&ref=1"] * 3
    bad += [f"http://other{i}.net/" for i in range(100)]
    blocked = spark.createDataFrame([(u,) for u in bad], "url string")
    canonical = {r.u: r.c for r in frame.select(frame.url.alias("u"), canonical_url(frame.url).alias("c")).collect()}
    named = {r.c for r in blocked.select(canonical_url(blocked.url).alias("c")).collect()} - {None}
    found = judge_urls(frame, blocked, max_blocks=max_blocks).collect()
    assert len(found) == len(urls) + 3
    for row in found:
        url = urls[row.page_id]
        host, path = parts(url)
        assert (row.host, row.path) == (host, path)
        text, verdict = rule(host, path, RULES)
        assert row.listed == (canonical[url] in named)
        assert (row.rule, row.verdict) == (text, verdict or ("block" if row.listed else "allow"))
    assert sum(r.listed for r in found) >= 2


def test_canonical_forms(spark):
    frame = spark.createDataFrame([(u,) for u in URLS[-5:-1]], "url string")
    got = [r.c for r in frame.select(canonical_url(frame.url).alias("c")).collect()]
    assert got[0] == got[1] == "a.net/p?a=1&b=2"[: len(got[0])]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert judge_urls(pages, pages.filter("false")).first().verdict == "allow"
    assert judge_urls(pages.filter("false"), pages).count() == 0


def test_filter_size_is_bounded():
    assert [bloom_blocks(n) for n in (0, 1, 10**12)] == [2, 2, 1 << 17]


def test_list_from_html(spark):
    """Other spellings of a listed page, and pages it links to, are caught; the same host alone is not."""
    rows = [
        (1, "http://A.net/p/?utm_source=x", '<p>### <a href="/q/?b=1&a=2">y</a> <a href="/gone">z</a>'),
        (2, "https://a.net/p#top", "<p>clean"),
        (3, "ftp://a.net/q?a=2&b=1", None),
        (4, "http://a.net/r", '<a href="/p">'),
        (5, "http://b.net/p", "## **"),
        (6, None, "###"),
        (7, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(r.url for r in junk_urls(pages).collect()) == ["http://A.net/p/?utm_source=x", "http://a.net/gone", "http://a.net/q/?b=1&a=2"]
    found = judge_urls(pages, junk_urls(pages)).collect()
    assert sorted(r.page_id for r in found if r.listed) == [1, 2, 3] and len(found) == 7
