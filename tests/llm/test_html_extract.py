import random

import pytest

import stopfield.llm.html_extract as extract


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_common_lines_against_the_table(monkeypatch, bits):
    monkeypatch.setattr(extract, "MOST_BITS", bits)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        kept, rest = extract.common(a, b), iter(b)
        assert kept == sorted(set(kept)) and len(kept) == longest(a, b) and all(a[i] in rest for i in kept)


PAGE = """<html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld<br>two<p>Three&nbsp;four
<div class="ad">Buy</div><form><input>Name</form></article><section id="comments"><article>First!</article></section><aside>Side</aside>
<footer>&copy; foot</footer></body></html>"""


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, bucket string")


def texts(df):
    return {r.page_id: r.text for r in extract.extracted(df).collect()}


def test_named_main_text(spark):
    assert texts(frame(spark, [(1, "http://a/x", PAGE)])) == {1: "Head & line One bold two Three four"}


def test_shared_lines_go_without_named_main_text(spark):
    page = lambda body: f"<body><div>Top line</div><p>{body}</p><div>Bottom line</div></body>"
    rows = [(1, "http://a/n/1", page("first body")), (2, "http://a/n/2", page("second body")), (3, "http://a/zzz", page("third body")), (4, "http://b/n/1", page("alone"))]
    assert texts(frame(spark, rows).repartition(3)) == {1: "first body", 2: "second body", 3: "third body", 4: "Top line alone Bottom line"}


def test_nearest_neighbour_is_the_one_with_the_longer_path_prefix(spark):
    rows = [(1, "http://a/m/1", "<p>left</p><p>own 1</p>"), (2, "http://a/m/2", "<p>left</p><p>right</p>"), (3, "http://a/n/1", "<p>right</p>")]
    assert texts(frame(spark, rows))[2] == "right"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url", ""), (None, "http://h/p", "plain"), (4, "http://h/p", "plain"), (5, "http://k", "<p>a" + "<div>b" * 3000), (6, "http://k?q", "x < y <b")]
    got = texts(frame(spark, rows))
    assert got[1] == got[2] == "" and got[5].startswith("a b b") and len(extract.extracted(frame(spark, rows)).collect()) == 6
    assert extract.extracted(frame(spark, rows).limit(0)).collect() == []


def test_a_hot_host_over_many_partitions(spark):
    rows = [(i, f"http://a/{i:04d}", f"<div>Same</div><p>body {i}</p>") for i in range(400)]
    assert texts(frame(spark, rows).repartition(11)) == {i: f"body {i}" for i in range(400)}


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar"><article class="post comments-open"><p>one</p></article></body>',
        '<body class="sidebar"><main class="widget"><p>one</p></main></body>',
        '<div id="page" class="no-menu"><article><p>one</p></article></div>',
        '<div class="widget"><main><p>one</p></main></div><div class="menu">x</div>',
        '<div class="widget"><article><p>one</p></article></div>',
        '<article><p title="the hidden valley">one</p><div class="cookie-notice">x</div><p hidden>x</p><p aria-hidden="true">x</p><p style="display: none">x</p></article>',
        '<article><svg viewBox="0"/><p>one</p><svg><text>x</text></svg></article>',
    ],
)
def test_names_that_do_not_make_main_text_other(page):
    assert extract.main_text(extract.text_lines(page), None) == "one"


@pytest.mark.parametrize(
    "mark", ['class="ad-slot"', 'class="ad-container"', 'class="google-ad"', 'class="adsbygoogle"', 'class="comment-list"', 'class="x comments-section"', 'class="post-comments"', 'id="disqus_thread"', 'class="cookie-bar"',
             'class="related-posts"', 'class="newsletter-signup"', 'id="sidebar-left"', 'class="main-menu"', 'class="mainMenu"', 'role="complementary"', 'role="contentinfo"', 'role="search"', "hidden", 'style="display: none"'],
)
@pytest.mark.parametrize("element", ["div", "section", "span"])
def test_what_is_named_as_other_goes(mark, element):
    page = f"<article><p>one</p><p>two <{element} {mark}>gone <b>and</b> gone</{element}> three</p></article>"
    assert extract.main_text(extract.text_lines(page), None).split() == ["one", "two", "three"]


def test_top_and_foot_of_a_page_without_main_text():
    page = '<body><div class="top-nav">N</div><p>hello</p><div class="site-footer">F</div></body>'
    assert extract.main_text(extract.text_lines(page), None) == "hello"


@pytest.mark.parametrize(
    "page", ['<body class="has-sidebar no-menu"><article class="post comments-open">whole text</article></body>', '<div id="page" class="with-sidebar"><article>whole text</article></div>',
             '<article>whole text</article><article class="comment">a reader</article>', '<article class="comment">whole text</article>', '<div class="widget"><article>whole text</article></div>',
             '<main class="sidebar-layout"><p title="the hidden valley">whole text</p></main>', '<article>whole <span class="ad">buy</span><i>text</i></article>', '<article>whole <span class="ad">buy <p>text</p></article>'],
)
def test_whole_articles_stay(page):
    assert extract.main_text(extract.text_lines(page), None) == "whole text"


def test_a_very_long_page_and_clashing_columns(spark):
    page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</article>"
    df = frame(spark, [(1, "http://a/x", page), (2, "http://a/y", page)]).selectExpr("*", "1 AS host", "2 AS path", "3 AS copy", "4 AS digest", "5 AS id_key", "6 AS text")
    got = extract.extracted(df).collect()
    assert [r.n_chars for r in got] == [len(" ".join(f"line {i}" for i in range(30_000)))] * 2


def test_plans_are_built_at_once_for_many_partitions(spark):
    import time

    from stopfield.llm import order_minhash
    from stopfield.llm.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8")
    try:
        for name in ("op4_order_minhash", "op5_html_extract"):
            start = time.perf_counter()
            plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert time.perf_counter() - start < 60 and len(plan) < 40_000, name
        assert order_minhash is not None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
