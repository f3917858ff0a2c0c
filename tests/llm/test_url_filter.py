import pytest

from stopfield.llm import url_filter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("#", 1)[0].split("?", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if host else []
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://Example.COM/de/1", "http://a.example.com/de", "https://x.example.com/de/q?x#y", "http://example.net", "http://example.net/", "http://net/",
    "http://a.net/en/", "http://www.example.net/en/a", "http://wwwexample.net/en/a", "http://b.org/fr/?q=/x", "http://org/fr/", "http://b.org/FR/", "://net/", "a://b://c.net/d", "http://net?x/", "http://.net/x",
]


@pytest.mark.parametrize("blocks", [1, 64, url_filter.BLOCKS])
def test_verdicts_against_brute_force(spark, blocks):
    rules = [*url_filter.RULES, ("x.example.com", "/d", "allow"), ("a.net", "/en/", "block"), ("b.org", "", "block")]
    listed = spark.createDataFrame([*rules, rules[0]], "host string, path string, verdict string")
    pages = spark.createDataFrame([(u, "h") for u in URLS], "url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, listed, blocks=blocks).collect()}
    assert got == {u: brute(u, rules) for u in URLS}


def test_the_filter_drops_most_other_keys(spark):
    keys = spark.range(500).selectExpr("concat('listed', id) AS key")
    others = spark.range(2000).selectExpr("concat('other', id) AS key")
    row = url_filter.bloom(keys)
    passes = lambda df: df.crossJoin(row).filter(url_filter.may_hold(row["filter"], df["key"])).count()
    assert passes(keys) == 500 and passes(others) < 40


def test_rows_are_kept(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    assert len(url_filter.url_verdicts(pages, rules).collect()) == 4
    assert url_filter.url_verdicts(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}
