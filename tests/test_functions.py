"""URL algebra, health, the tree and JSON paths."""

import re
from posixpath import normpath
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequery.functions import dom, health, jsonpaths, urls


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def plain_canonical(url, base=None):
    """The same by the standard library."""
    url = url.strip("".join(map(chr, range(33))))
    try:
        s = urlsplit(urljoin(base, url) if base else url)
    except ValueError:
        return None
    if s.scheme.lower() not in ("http", "https") or not s.netloc:
        return None
    host = s.netloc.lower()
    host = host.removesuffix(":80") if s.scheme.lower() == "http" else host.removesuffix(":443")
    path = normpath(s.path) if s.path else "/"
    query = sorted((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if k not in urls.TRACKING and not k.startswith("utm_"))
    return urlunsplit((s.scheme.lower(), host, path, urlencode(query), ""))


CANONICAL = [
    ("https://WWW.Foo.com/a/?utm_source=x&b=2&a=1#frag", None), ("mailto:x@y.com", None), ("../b.html", "http://h.com/x/y/a.html"), ("?q=1", "http://h.com/x?z=2#f"), ("//o.org/p", "https://h.com/"),
    ("/r/./s/../t/", "http://h.com/x"), ("http://h.com:80/", None), ("https://h.com:443/a", None), ("https://h.com:80", None), ("http://h.com/a%20b?x=a+b&y=%7E*", None), ("http://[x", None), ("  http://h.com/a|b  ", None),
    ("", "http://h.com/a?b=1"), ("#top", "http://h.com/a"), ("http://h.com?a=&b", None), ("HTTP://U@H.com/../a//b/", None), ("http://h.com/é?é=ü", None), ("c/d", "http://h.com"), ("http://h.com/?ref=1&source=2&gclid=3", None), ("javascript:void(0)", "http://h.com/"),
]


def test_canonical_agrees_with_the_standard_library(spark):
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(CANONICAL)], "i int, u string, b string")
    got = {r.i: r.x for r in df.select("i", F.when(F.col("b").isNull(), urls.canonical(F.col("u"))).otherwise(urls.canonical(F.col("u"), F.col("b"))).alias("x")).collect()}
    for i, (u, b) in enumerate(CANONICAL):
        assert got[i] == plain_canonical(u, b), u
    assert got[0] == "https://www.foo.com/a?a=1&b=2" and got[2] == "http://h.com/x/b.html"
    assert one(spark, urls.canonical(F.lit(None).cast("string"))) is None


def test_canonical_is_idempotent_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    c = urls.canonical(F.col("url"))
    assert pages.filter(urls.canonical(c) != c).count() == 0 and pages.filter(c.isNull()).count() == 0
    for r in pages.select("url", c.alias("c")).collect():
        assert r.c == plain_canonical(r.url)


@pytest.mark.parametrize(("url", "group", "template"), [
    ("https://f.com/portfolio/airbnb", "f.com/portfolio/*", "f.com/portfolio/*"), ("https://f.com/about", None, "f.com/about"), ("https://f.com/companies/12/x", "f.com/companies/{n}/*", "f.com/companies/{n}/*"),
    ("https://www.f.com:8080/a/123456789012/z", "f.com/a/{id}/*", "f.com/a/{id}/*"), ("https://f.com/", None, "f.com/"), ("https://f.com/a١٢b3/x", "f.com/a{n}b{n}/*", "f.com/a{n}b{n}/*"), ("nothing", None, "?/"),
    ("https://f.com/x/0b0e1f6a-1234-4abc-8def-0123456789ab/y?z#f", "f.com/x/{id}/*", "f.com/x/{id}/*"),
])
def test_keys(spark, url, group, template):
    assert one(spark, urls.group_key(F.lit(url))) == group and one(spark, urls.template_key(F.lit(url))) == template


def test_domains_and_deny(spark):
    rows = [("https://www.LinkedIn.com/in/a", "linkedin.com", True), ("x.com", "x.com", True), ("https://u@m.x.com:9/a", "m.x.com", True), ("https://notx.com", "notx.com", False), ("www.foo.org/path", "foo.org", False)]
    for u, d, no in rows:
        assert one(spark, urls.domain(F.lit(u))) == d and one(spark, urls.denied(F.lit(u))) is no
    urls.register(spark)
    assert spark.sql("SELECT page_domain('https://www.Foo.org:80/x') AS d, page_host_key('https://www.foo.org/x') AS h, page_host_key('none') AS n").first() == ("foo.org", "foo.org", "?")


LONG = "word " * 300
ISLAND = '<script type="application/json">{"a": "' + "x" * 2100 + '"}</script>'


@pytest.mark.parametrize(("status", "html", "text", "expected"), [
    (200, "<p>" + LONG, LONG, "ok"), (200, "<title>Just a moment...</title>", LONG, "blocked"), (403, "<p>x", LONG, "blocked"), (500, "<p>x", LONG, "http_error"), (200, None, None, "error"), (200, "", "", "error"),
    (200, "<title>Page not found</title><p>x", LONG, "soft_404"), (200, '<div id="root"></div>', "", "js_shell"), (200, '<div id="root"></div>' + ISLAND, "", "data_shell"), (200, '<div id="root"></div>' + ISLAND.replace("}", ""), "", "js_shell"),
    (200, "<p>" + " " * 6000 + '<div id="root">', LONG[:550], "ok"), (200, "<p></p>", " ", "empty"), (None, "<p>" + LONG, LONG, "ok"), (200, "<p>short", "We use cookies here", "wall"), (200, "<p>x" + " " * 9000, "tiny text", "js_shell"), (200, "<p>x", "Sorry, this item is no longer available", "soft_404"),
])
def test_health(spark, status, html, text, expected):
    assert one(spark, health.classify(F.lit(status).cast("int"), F.lit(html).cast("string"), F.lit(text).cast("string"))) == expected


def test_better_page(spark):
    page = lambda h, html: F.struct(F.lit(h).alias("health"), F.lit(html).alias("html"))
    pick = lambda a, b: one(spark, health.better(a, b))
    assert pick(page("js_shell", "xxx"), page("ok", "x")).health == "ok"
    assert pick(page("ok", "xx"), page("soft_404", "xxx")).health == "ok"
    assert pick(page("empty", "aa"), page("empty", "bb")).html == "bb" and pick(page("empty", "aaa"), page("empty", "bb")).html == "aaa"
    assert one(spark, health.rank(F.lit("odd"))) == 9


def test_tree_repairs_and_text():
    root = dom.parse("<title>a <b>&amp; c</title><ul><li>1<li>2<ul><li>x</ul><li>3</ul><p>p<p>q<div>d<p>r</div>s<br>t<script>if(a<b){'</p>'}</script><table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in dom.select(root, "title")] == ["a <b>& c"]
    assert [n.text() for n in dom.select(root, "ul:first-of-type > li")] == ["1", "2 x", "x", "3"]
    assert [n.text() for n in dom.select(root, "p")] == ["p", "q", "r"]
    assert [len(dom.select(n, "td")) for n in dom.select(root, "tr")] == [2, 1]
    assert "".join(dom.select_one(root, "script").strings()) == "if(a<b){'</p>'}"
    assert dom.parse(None).text() == "" and dom.select(dom.parse("</p></div>x"), "p") == []


PAGE = '<div id="a" class="x y"><p lang="en-US">1</p><p class="z" data-k="v w">2</p><span><a href="/q?a=1" rel="next nofollow">l</a></span><p>3</p></div><div class="x"><p>4</p></div>'


@pytest.mark.parametrize(("selector", "texts"), [
    ("#a > p", "123"), ("div.x.y p.z", "2"), ("[data-k~=w]", "2"), ("[data-k='v w']", "2"), ("a[href^='/q']", "l"), ("a[href$=\"1\"]", "l"), ("a[href*=q]", "l"), ("p[lang|=en]", "1"), ("p + p", "2"), ("p ~ p", "23"), ("p:first-child", "14"),
    ("div > p:last-child", "34"), ("p:nth-child(2)", "2"), ("p:nth-of-type(odd)", "134"), ("p:not(.z):not([lang])", "34"), ("a, p.z", "2l"), ("div:last-of-type p", "4"), ("* > a", "l"), ("meta[property=og:title]", ""),
])
def test_selectors(selector, texts):
    assert "".join(n.text() for n in dom.select(dom.parse(PAGE), selector)) == texts


@pytest.mark.parametrize("selector", ["p:hover", "", "p >", "p,,a", "p:nth-child(x)", "::before", "p[", "a:not(", "1x"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(dom.SelectorError):
        dom.compile_selector(selector)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab=\"' &;!-p\né", max_size=80))
def test_any_text_parses(text):
    root = dom.parse(text)
    assert sum(len(s) for s in root.strings()) <= len(text) + 2
    assert isinstance(root.html(), str)


def test_json_paths():
    item = {"a": [{"b": 1}, {"b": "/x"}], "n": 0, "s": " t ", "o": {"name": "N"}, "l": [None, {"q": 1}, 5], "0": "zero"}
    step = jsonpaths.step_into
    assert (step(item, "a.1.b"), step(item, "a.b"), step(item, "a.9.b"), step(item, "0"), step(item, ""), step(item, "n.x")) == ("/x", 1, None, "zero", item, None)
    value = lambda p: jsonpaths.island_value(item, p, "http://h.com/d/")
    assert (value("a.1.b"), value("n"), value("s"), value("o"), value("l"), value("zz")) == ("http://h.com/x", 0, "t", None, 5, None)
    linked = jsonpaths.linked_data_value
    assert (linked(item, "o"), linked(item, "a.b"), linked({"p": 9.99}, "p"), linked({"p": True}, "p"), linked({"i": {"@id": "u"}}, "i"), linked({"p": 0}, "p")) == ("N", "1", "9.99", "True", "u", None)
    assert jsonpaths.loose_json('```json\n{"a": 1}\n```') == {"a": 1} and jsonpaths.loose_json("so: [1, 2] ok") == [1, 2] and jsonpaths.loose_json("none {") is None


def test_patterns_are_what_they_say():
    assert re.search(health.COOKIES, "manage all cookies") and not re.search(health.NOT_FOUND, "4045")
