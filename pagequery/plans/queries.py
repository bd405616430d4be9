"""The registered queries and their SQL: every operator over whole fixture tables.

Where the fixture pages lack something (JSON-LD, islands, cards), a query builds
pages from a fixture table and reads them back, so that plain SQL over the table
tells what must come out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.config import Settings
from pagequery.functions import health, urls
from pagequery.operators import extract as ex
from pagequery.operators import links as ln
from pagequery.operators import policy
from pagequery.operators.facts import page_blocks, page_facts, page_links, page_texts
from pagequery.sources.sitemaps import locations
from pagequery.sources.store import content_hash, export, fresh, latest, new_records, next_versions
from pagequery.streaming import streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NAV = {"kind": "list", "item_selector": "nav li", "fields": {"name": {"sel": "a", "attr": "text"}, "url": {"sel": "a", "attr": "href"}}}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Tasks for passes over pages: a file of pages is a task or two, and reading a page takes long."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the navigation lists of all pages."""
    pages = pages_of(spark, sf_dir).withColumn("id", F.col("page_id"))
    found = ex.extract(pages, NAV, key="page_id", base="url", spread=spread(spark))
    return ex.pivot(found, ["name", "url"]).select(F.col("page_id").cast("long").alias("page_id"), "item_pos", "name", "url")


# ---- SQL pieces

_CANON = """(SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || regexp_extract(url, '://([^/?#]*)', 1) AS origin,
  regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(.)/$', '\\1') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages)"""
_CANONICAL = f"""(SELECT page_id, url, origin || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical, origin, path
 FROM (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT regexp_matches(p, '^(ref|source)=')) AS kept FROM {_CANON}))"""
_KEYS = f"""(SELECT page_id, url, canonical, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www[.]', '') AS host,
 regexp_replace(string_split(trim(path, '/'), '/')[1], '[0-9]+', '{{n}}', 'g') AS first, regexp_replace(string_split(trim(path, '/'), '/')[2], '[0-9]+', '{{n}}', 'g') AS second FROM {_CANONICAL})"""


# ---- URL algebra


@query(f"SELECT page_id, canonical FROM {_CANONICAL}")
def url_canonicalize(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, host AS domain, host AS host_key, host || '/' || first || '/*' AS group_key, host || '/' || first || '/*' AS template_key FROM {_KEYS}")
def url_keys(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select("page_id", urls.domain(u).alias("domain"), urls.host_key(u).alias("host_key"), urls.group_key(u).alias("group_key"), urls.template_key(u).alias("template_key"))


def _deny_url(i: Column) -> Column:
    return F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, ("www.linkedin.com", "x.com", "notx.com", "m.facebook.com", "example.com", "x.com.example.org"))), (i % 6 + 1).cast("int")), F.lit("/in/"), i.cast("string"))


@query("""SELECT p_partkey, u AS url FROM (SELECT p_partkey, 'https://' || ['www.linkedin.com', 'x.com', 'notx.com', 'm.facebook.com', 'example.com', 'x.com.example.org'][p_partkey % 6 + 1] || '/in/' || p_partkey AS u FROM part)
WHERE NOT regexp_matches(u, '://([^/]*[.])?(linkedin|crunchbase|pitchbook|facebook|twitter|x|instagram|glassdoor)[.]com/')""")
def deny_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _deny_url(F.col("p_partkey")).alias("url")).filter(~urls.denied(F.col("url")))


@query(f"SELECT canonical, max(page_id) AS page_id, count(*) AS versions FROM {_CANONICAL} GROUP BY canonical")
def pages_dedup_latest(spark, sf_dir):
    pages = pages_of(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))
    counts = pages.groupBy("canonical").agg(F.count(F.lit(1)).alias("versions"))
    return latest(pages, ["canonical"], F.desc("page_id")).join(counts, "canonical").select("canonical", "page_id", "versions")


@query("SELECT page_id, substr(sha256(html), 1, 16) AS content_hash FROM pages")
def page_hashes(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", content_hash(F.col("html")).alias("content_hash"))


@query(f"SELECT pattern, n FROM (SELECT host || '/' || first || '/*' AS pattern, count(*) AS n FROM {_KEYS} GROUP BY ALL) ORDER BY n DESC, pattern LIMIT 40")
def site_patterns(spark, sf_dir):
    """The 40 commonest patterns of a sitemap made of the pages' addresses."""
    files = pages_of(spark, sf_dir).groupBy(F.pmod("page_id", F.lit(16)).alias("file")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("html"))
    return ln.site_patterns(locations(files.select(F.col("file").cast("string").alias("url"), "html")).select(F.col("loc").alias("url")))


# ---- facts of pages

_PLAIN = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_ARTICLE = """list_filter(list_transform(string_split(regexp_replace(x, '<[^>]*>', chr(1), 'g'), chr(1)), lambda s: trim(PLAIN, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')""".replace("PLAIN", _PLAIN("s"))
_TEXTS = f"""(SELECT page_id, url, html, CASE WHEN length(a) >= 200 THEN a ELSE b END AS text FROM (SELECT page_id, url, html,
  array_to_string(list_filter({_ARTICLE.replace('x,', "regexp_extract(html, '<article>(.*?)(</article>|<footer>|$)', 1, 's'),", 1)}, lambda s: true), chr(10)) AS a,
  array_to_string({_ARTICLE.replace('x,', "regexp_extract(html, '</nav>(.*?)(<footer>|</body>|$)', 1, 's'),", 1)}, chr(10)) AS b FROM pages))"""


@query(f"SELECT page_id, length(text) AS text_chars, sha256(text) AS text_sha256 FROM {_TEXTS}")
def main_text(spark, sf_dir):
    return page_texts(pages_of(spark, sf_dir), spread=spread(spark)).select("page_id", F.char_length("main_text").cast("long").alias("text_chars"), F.sha2("main_text", 256).alias("text_sha256"))


@query(f"""SELECT page_id, substr(trim({_PLAIN("regexp_extract(html, '<title>(.*?)</title>', 1)")}), 1, 200) AS title, 'h1: ' || substr(trim({_PLAIN("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}), 1, 120) AS heading FROM pages""")
def page_titles(spark, sf_dir):
    return page_texts(pages_of(spark, sf_dir), spread=spread(spark)).select("page_id", "title", F.get("headings", F.lit(0)).alias("heading"))


_LINKS = f"""(SELECT page_id, url, pos, regexp_extract(l, 'href="([^"]*)"', 1) AS href, regexp_extract(l, '>([^<]*)<', 1) AS text FROM
  (SELECT page_id, url, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*<') AS ls FROM pages)))"""


@query(f"""SELECT page_id, min(pos) AS pos, origin || href AS link, arg_min(text, pos) AS text, 'nav' AS region FROM
 (SELECT l.page_id, pos, href, text, c.origin FROM {_LINKS} l JOIN {_CANONICAL} c ON l.page_id = c.page_id) GROUP BY page_id, origin, href""")
def link_extract(spark, sf_dir):
    rows = ln.link_rows(page_links(pages_of(spark, sf_dir), spread=spread(spark)), "page_id")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "link", "text", "region")


@query(f"SELECT page_id, sum(CASE WHEN length(href) > 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM {_LINKS} GROUP BY page_id")
def link_counts(spark, sf_dir):
    return page_links(pages_of(spark, sf_dir), spread=spread(spark)).select("page_id", F.size("links").cast("long").alias("n")).filter("n > 0")


_HEALTH = f"""(SELECT page_id, CASE WHEN status IN (401, 403, 407, 429, 451) THEN 'blocked' WHEN status >= 400 THEN 'http_error' WHEN n = 0 THEN 'empty'
  WHEN regexp_matches(lower(title), 'page not found|404\\b|doesn.t exist|no longer available|nothing (was )?found') THEN 'soft_404'
  WHEN n < 600 AND length(html) > 20 * n THEN 'js_shell' ELSE 'ok' END AS health
  FROM (SELECT page_id, html, length(text) AS n, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, [200, 200, 200, 403, 404, 500, 200][page_id % 7 + 1] AS status FROM {_TEXTS}))"""


def _healthy(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 200, 200, 403, 404, 500, 200))), (F.col("page_id") % 7 + 1).cast("int"))
    pages = pages_of(spark, sf_dir).withColumn("raw", F.col("html"))
    return page_texts(pages, spread=spread(spark)).select("page_id", health.classify(status, F.col("raw"), F.col("main_text")).alias("health"))


@query(f"SELECT page_id, health FROM {_HEALTH}")
def page_health(spark, sf_dir):
    return _healthy(spark, sf_dir)


@query(f"SELECT health, count(*) AS pages FROM {_HEALTH} GROUP BY health")
def health_histogram(spark, sf_dir):
    return _healthy(spark, sf_dir).groupBy("health").agg(F.count(F.lit(1)).alias("pages"))


@query(f"""SELECT t.page_id, t.title, t.heading, length(x.text) AS text_chars, substr(x.text, 1, 400) AS text_preview, coalesce(l.n, 0)::BIGINT AS links_total, l.singles, 0 AS omitted, 0 AS groups
FROM (SELECT page_id, substr(trim({_PLAIN("regexp_extract(html, '<title>(.*?)</title>', 1)")}), 1, 200) AS title, 'h1: ' || substr(trim({_PLAIN("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}), 1, 120) AS heading FROM pages) t
JOIN {_TEXTS} x ON t.page_id = x.page_id
LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(text || '=' || link, '|' ORDER BY pos) AS singles FROM
 (SELECT l.page_id, min(pos) AS pos, origin || href AS link, arg_min(text, pos) AS text FROM _LINKS_ l JOIN {_CANONICAL} c ON l.page_id = c.page_id GROUP BY l.page_id, origin, href) GROUP BY page_id) l ON t.page_id = l.page_id""".replace("_LINKS_", _LINKS))
def page_outlines(spark, sf_dir):
    """Outlines of all pages; their links have one folder, so none makes a group. The groups of outlines are in outline_parts."""
    pages = pages_of(spark, sf_dir).withColumn("status", F.lit(200)).withColumn("health", F.lit("ok"))
    out = ln.outline(page_facts(pages, spread=spread(spark)), keep=("page_id",))
    singles = F.array_join(F.transform("singles", lambda x: F.concat(x["text"], F.lit("="), x["link"])), "|")
    return out.select("page_id", "title", F.get("headings", F.lit(0)).alias("heading"), F.col("text_chars").cast("long").alias("text_chars"), "text_preview", "links_total", singles.alias("singles"), F.col("omitted").cast("int").alias("omitted"), F.coalesce(F.size("groups"), F.lit(0)).alias("groups"))


@query(f"SELECT host || '/' || first || '/*' AS template, count(*) AS pages FROM {_KEYS} GROUP BY ALL")
def template_clusters(spark, sf_dir):
    facts = page_facts(pages_of(spark, sf_dir), spread=spread(spark))
    return ex.clusters(facts).groupBy("template").agg(F.sum("pages").alias("pages"))


# ---- generated pages


def _text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def listing_pages(spark, sf_dir) -> DataFrame:
    """(url, html): a page of cards for each brand of part."""
    card = F.concat(F.lit('<div class="card"><h3>'), _text(F.col("p_name")), F.lit('</h3><p class="d">'), _text(F.col("p_type")), F.lit('<p>more<a href="/parts/'), F.col("p_partkey").cast("string"), F.lit('">see</a></div>'))
    cards = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "\n").alias("cards"))
    slug = F.replace("p_brand", F.lit("#"), F.lit("-"))
    return cards.select(F.concat(F.lit("https://shop.example/brands/"), slug).alias("url"), "p_brand", F.concat(F.lit('<html><body><nav><a href="/">home</a><a href="https://x.com/us">x</a></nav><main>'), "cards", F.lit("</main><footer><a href=/imprint>imprint</a></footer></body></html>")).alias("html"))


CARDS = {"kind": "list", "item_selector": "main > div.card", "fields": {"name": {"sel": "h3", "attr": "text"}, "type": {"sel": "p.d", "attr": "text"}, "url": {"sel": "a[href^='/parts/']", "attr": "href"}}}


@query("SELECT p_brand AS brand, p_name AS name, p_type AS type, 'https://shop.example/parts/' || p_partkey AS url FROM part")
def list_spec(spark, sf_dir):
    pages = listing_pages(spark, sf_dir).select("url", "p_brand", "html")
    found = ex.pivot(ex.extract(pages, CARDS, key="p_brand", base="url", spread=spread(spark)), ["name", "type", "url"])
    return found.select(F.col("p_brand").alias("brand"), "name", "type", "url")


@query("""SELECT 'https://shop.example/brands/' || replace(p_brand, '#', '-') AS url, 'shop.example/parts/*' AS id, 'main' AS region, count(*) AS count, false AS external,
 'https://shop.example/parts/' || min(p_partkey) AS first_sample FROM part GROUP BY p_brand HAVING count(*) >= 4""")
def link_groups(spark, sf_dir):
    rows = ln.link_rows(page_links(listing_pages(spark, sf_dir), spread=spread(spark)))
    return ln.link_groups(rows).select("url", "id", "region", "count", "external", F.get("samples", F.lit(0))["url"].alias("first_sample"))


@query("""SELECT 'https://shop.example/brands/' || replace(p_brand, '#', '-') AS url, singles, denied FROM (SELECT DISTINCT p_brand FROM part), (SELECT 2::BIGINT AS singles, 1::BIGINT AS denied)
 WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 4)
 UNION ALL SELECT 'https://shop.example/brands/' || replace(p_brand, '#', '-'), 2 + count(*), 1 FROM part GROUP BY p_brand HAVING count(*) < 4""")
def link_singles(spark, sf_dir):
    rows = ln.link_rows(page_links(listing_pages(spark, sf_dir), spread=spread(spark)))
    singles = ln.single_links(rows).groupBy("url").agg(F.count(F.lit(1)).alias("singles"))
    return singles.join(ln.denied_counts(rows).groupBy("url").agg(F.sum("n").alias("denied")), "url")


@query("""SELECT 'https://shop.example/brands/' || replace(p_brand, '#', '-') AS url, 'div.card' AS selector, count(*)::INTEGER AS count, 'shop.example/parts/*' AS contains FROM part GROUP BY p_brand HAVING count(*) >= 4""")
def repeat_blocks(spark, sf_dir):
    pages = page_blocks(listing_pages(spark, sf_dir), spread=spread(spark))
    return ln.repeats(pages, ln.link_groups(ln.link_rows(pages))).select("url", "selector", "count", "contains")


def outlined_pages(spark, sf_dir) -> DataFrame:
    """listing_pages() of four cards or more, with three groups of links, single ones beyond what is shown, and a next page."""
    more = "".join(f'<a href="/nav/a{i}">n{i}</a>' for i in range(4))
    aside = "<aside>" + "".join(f'<a href="https://other.example/p/q{i}">o{i}</a>' for i in range(5)) + "</aside>"
    foot = "<footer>" + "".join(f'<a href="/f{i}">f{i}</a>' for i in range(45)) + '</footer><a rel="next" href="?page=2">»</a>'
    big = table(spark, sf_dir, "part").groupBy("p_brand").count().filter("count >= 4").select("p_brand")
    html = F.replace(F.replace("html", F.lit("</nav>"), F.lit(more + "</nav>")), F.lit("<footer><a href=/imprint>imprint</a></footer>"), F.lit(aside + foot))
    return listing_pages(spark, sf_dir).join(big, "p_brand", "left_semi").select("url", html.alias("html"), F.lit(200).alias("status"), F.lit("ok").alias("health"))


@query("""SELECT 'https://shop.example/brands/' || replace(p_brand, '#', '-') AS url, n + 57 AS links_total,
 '1:shop.example/parts/*:main:' || n || ':false:5:https://shop.example/parts/' || first || '|2:shop.example/nav/*:nav:4:false:4:https://shop.example/nav/a0|3:other.example/p/*:aside:5:true:5:https://other.example/p/q0' AS groups,
 40 AS singles, 'home=https://shop.example/|»=https://shop.example/brands/' || replace(p_brand, '#', '-') || '?page=2' AS first_singles, 7 AS omitted, 'footer:7' AS by_region, 'x.com:1' AS denied,
 '1:div.card:' || n || ':' || chars || ':' || sample || ':shop.example/parts/*' AS repeats, 'https://shop.example/brands/' || replace(p_brand, '#', '-') || '?page=2' AS next_page
FROM (SELECT p_brand, count(*) AS n, min(p_partkey) AS first, list_sum(cards[1:20])::BIGINT // len(cards[1:20]) AS chars, sample FROM
  (SELECT p_brand, p_partkey, list(length(p_name) + length(p_type) + 10) OVER w AS cards, first_value(substr(p_name || ' ' || p_type || ' more see', 1, 200)) OVER w AS sample FROM part
   WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY p_brand, cards, sample HAVING count(*) >= 4)""")
def outline_parts(spark, sf_dir):
    """Outlines of generated listings: the order of groups and singles, what is left out, denied links, repeated blocks, next page."""
    pair = lambda a, b: lambda x: F.concat_ws("=", x[a], x[b])
    group = lambda g: F.concat_ws(":", *[g[c].cast("string") for c in ("place", "id", "region", "count", "external")], F.size(g["samples"]).cast("string"), F.get(g["samples"], F.lit(0))["url"])
    block = lambda b: F.concat_ws(":", *[b[c].cast("string") for c in ("place", "selector", "count", "avg_text_chars", "sample_text", "contains")])
    counts = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return ln.outline(page_facts(outlined_pages(spark, sf_dir), spread=spread(spark))).select(
        "url", "links_total", F.array_join(F.transform("groups", group), "|").alias("groups"), F.size("singles").alias("singles"), F.array_join(F.transform(F.slice("singles", 1, 2), pair("text", "link")), "|").alias("first_singles"),
        F.col("omitted").cast("int").alias("omitted"), counts("by_region").alias("by_region"), counts("denied").alias("denied"), F.array_join(F.transform("repeats", block), "|").alias("repeats"), "next_page",
    )


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, 'https://crm.example/n/' || c_nationkey AS nation FROM customer")
def detail_spec(spark, sf_dir):
    page = F.concat(F.lit("<html><body><h1> "), _text(F.col("c_name")), F.lit(" </h1><p class='desc seg'>"), _text(F.col("c_mktsegment")), F.lit("<p>x<a class=site href='/n/"), F.col("c_nationkey").cast("string"), F.lit("'>nation</a>"))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://crm.example/c/"), F.col("c_custkey").cast("string")).alias("url"), page.alias("html"))
    spec = {"kind": "detail", "fields": {"name": {"sel": "h1"}, "segment": {"sel": "p.desc:first-of-type"}, "nation": {"sel": "a.site", "attr": "href"}}}
    return ex.pivot(ex.extract(pages, spec, key="c_custkey", base="url", spread=spread(spark)), ["name", "segment", "nation"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "name", "segment", "nation")


def island_pages(spark, sf_dir) -> DataFrame:
    """(url, html, r_regionkey): a page for each region whose data script holds its nations."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.concat(F.lit("/n/"), "n_nationkey").alias("url")).alias("link"), F.array(F.lit("tag"), F.col("n_name")).alias("tags")))).alias("items"))
    body = F.concat(F.lit('{"props":{"pageProps":{"nations":'), F.to_json("items"), F.lit(',"pad":"'), F.repeat(F.lit("x"), 2000), F.lit('"}}}'))
    return nations.select(F.concat(F.lit("https://geo.example/r/"), F.col("n_regionkey").cast("string")).alias("url"), F.col("n_regionkey").alias("r_regionkey"), F.concat(F.lit('<html><body><div id="__next"></div><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></body></html>")).alias("html"))


NATIONS = {"kind": "island", "island_selector": "script#__NEXT_DATA__", "path": "props.pageProps.nations", "fields": {"id": "id", "name": "name", "url": "link.url", "tag": "tags.1"}}


@query("SELECT n_regionkey AS r_regionkey, n_nationkey::VARCHAR AS id, n_name AS name, 'https://geo.example/n/' || n_nationkey AS url, n_name AS tag FROM nation")
def island_spec(spark, sf_dir):
    found = ex.pivot(ex.extract(island_pages(spark, sf_dir), NATIONS, key="r_regionkey", base="url"), ["id", "name", "url", "tag"])
    return found.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "id", "name", "url", "tag")


@query("SELECT 'https://geo.example/r/' || n_regionkey AS url, 'script#__NEXT_DATA__' AS selector, 'props.pageProps.nations' AS path, count(*)::INTEGER AS count, 'id,link,name,tags' AS keys, 'data_shell' AS health FROM nation GROUP BY n_regionkey HAVING count(*) >= 3")
def island_summary(spark, sf_dir):
    pages = island_pages(spark, sf_dir).withColumn("raw", F.col("html"))
    each = page_facts(pages).select("url", "raw", F.explode("islands").alias("i")).select("url", "raw", "i.selector", F.explode("i.arrays").alias("a"))
    return each.select("url", "selector", "a.path", "a.count", F.array_join("a.item_keys", ",").alias("keys"), health.classify(F.lit(200), F.col("raw"), F.lit("")).alias("health"))


@query("SELECT s_suppkey, s_name AS name, round(s_acctbal, 2)::VARCHAR AS price, 'n' || s_nationkey AS brand FROM supplier")
def jsonld_records(spark, sf_dir):
    node = F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":"site"},{"@type":"Product","name":"'), "s_name", F.lit('","brand":{"name":"n'), F.col("s_nationkey").cast("string"), F.lit('"},"offers":[{"price":"'), F.format_string("%s", F.col("s_acctbal").cast("decimal(15,2)").cast("double")), F.lit('"}]}]}'))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("url"), F.concat(F.lit('<html><head><script type="application/ld+json">'), node, F.lit("</script></head><body>x</body></html>")).alias("html"))
    found = ex.pivot(ex.linked_data(pages, ["name", "price", "brand", "sku"], spread=spread(spark)), ["name", "price", "brand"])
    return found.select(F.col("url").cast("long").alias("s_suppkey"), "name", "price", "brand")


@query("SELECT r_regionkey, r_name AS og_title, 2 AS scopes, 'schema.org/Place,schema.org/Thing' AS types, 'name,text' AS props, 'https://r.example/r/' || (r_regionkey + 1) AS next_page, 'd ' || r_name AS description FROM region")
def page_metadata(spark, sf_dir):
    page = F.concat(
        F.lit('<html><head><meta property="og:title" content="'), "r_name", F.lit('"><meta name="description" content="d '), "r_name", F.lit('"><link rel="x next" href="/r/'), (F.col("r_regionkey") + 1).cast("string"),
        F.lit('"></head><body><div itemscope itemtype="https://schema.org/Place"><span itemprop="name">a</span><i itemscope itemtype="http://schema.org/Thing" itemprop="text">b</i></div></body></html>'),
    )
    facts = page_facts(table(spark, sf_dir, "region").select("r_regionkey", F.lit("https://r.example/r").alias("url"), page.alias("html")))
    return facts.select("r_regionkey", F.col("og")["title"].alias("og_title"), "microdata.scopes", F.array_join("microdata.types", ",").alias("types"), F.array_join("microdata.props", ",").alias("props"), urls.canonical(F.col("next_href"), F.col("url")).alias("next_page"), F.col("meta_description").alias("description"))


# ---- quality, specs, store


def part_records(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 != 0, F.when(F.col("p_size") > 40, F.lit("same")).otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_brand", F.create_map(F.lit("name"), name, F.lit("type"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_type"))).alias("data"))


@query("""SELECT p_brand, n AS records, list_filter([CASE WHEN 1 - a / n > 0.5 THEN 'name is mostly null' END, CASE WHEN a >= 4 AND d < 0.5 * a THEN 'name repeats' END, CASE WHEN 1 - b / n > 0.8 THEN 'type is null' END], lambda x: x IS NOT NULL).array_to_string(',') AS problems
FROM (SELECT p_brand, count(*) AS n, count(v) AS a, count(DISTINCT v) AS d, count(t) AS b FROM (SELECT p_brand, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_size > 40 THEN 'same' ELSE p_name END END AS v, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS t FROM part) GROUP BY p_brand)""")
def output_health(spark, sf_dir):
    return ex.output_health(part_records(spark, sf_dir), ["name", "type"], ["p_brand"]).select("p_brand", "records", F.array_join("problems", ",").alias("problems"))


def part_specs(spark, sf_dir) -> DataFrame:
    """Specs of several versions: one for each part, by brand as template."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select(F.lit("shop.example").alias("domain"), F.col("p_brand").alias("template"), F.lit("name,price").alias("fields"), F.col("p_type").alias("spec"), rank.alias("version"), (F.col("p_size") > 10).alias("healthy"))


@query("SELECT p_brand AS template, arg_max(p_type, p_partkey) AS spec FROM part WHERE p_size > 10 GROUP BY p_brand UNION ALL SELECT 'none', NULL")
def spec_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.col("p_brand").alias("template")).distinct().union(spark.createDataFrame([("none",)], "template string"))
    kept = ex.cached_specs(found, part_specs(spark, sf_dir), "shop.example", ["Price", "name"])
    return kept.filter("spec is not null or template = 'none'").select("template", "spec")


@query("""SELECT template, CASE WHEN old IS NULL THEN 1 WHEN old = new THEN v ELSE v + 1 END::INTEGER AS version FROM
 (SELECT p_brand AS template, arg_max(p_type, p_partkey) AS old, count(*) AS v, CASE WHEN min(p_size) > 2 THEN 'changed' ELSE arg_max(p_type, p_partkey) END AS new FROM part GROUP BY p_brand UNION ALL SELECT 'fresh', NULL, 0, 'changed')""")
def spec_versions(spark, sf_dir):
    old = part_specs(spark, sf_dir)
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("template")).agg(F.when(F.min("p_size") > 2, F.lit("changed")).otherwise(F.max_by("p_type", "p_partkey")).alias("spec"))
    new = parts.union(spark.createDataFrame([("fresh", "changed")], "template string, spec string")).select(F.lit("shop.example").alias("domain"), "template", F.lit("name,price").alias("fields"), "spec")
    return next_versions(new, old).select("template", "version")


def fetched_pages(spark, sf_dir) -> DataFrame:
    """Events as fetches of one page for each user and type."""
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id")


CUTOFF = "2024-01-20 00:00:00"


@query(f"SELECT url, event_id FROM (SELECT event_type || '/' || user_id AS url, arg_max(event_id, ts) AS event_id, max(ts) AS t FROM events GROUP BY 1) WHERE t >= TIMESTAMP '{CUTOFF}'")
def cache_freshness(spark, sf_dir):
    newest = latest(fetched_pages(spark, sf_dir), ["url"], F.desc("fetched_at"), F.desc("event_id"))
    return fresh(newest, F.lit(CUTOFF).cast("timestamp")).select("url", "event_id")


@query("SELECT DISTINCT event_type AS run_id, user_id::VARCHAR AS source_url, 'k' || (user_id % 3) AS data FROM events WHERE user_id % 10 <> 0")
def record_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").cast("string").alias("source_url"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("data"))
    known = rows.filter(F.col("source_url").cast("long") % 10 == 0)
    return new_records(rows, known).select("run_id", "source_url", "data")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_visited(spark, sf_dir):
    visited = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return policy.unvisited(table(spark, sf_dir, "orders"), visited, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS known FROM orders")
def offered_semi(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    yes, no = policy.offered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")
    return yes.select("o_orderkey", F.lit(True).alias("known")).unionByName(no.select("o_orderkey", F.lit(False).alias("known")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE c_name END AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def record_enrich(spark, sf_dir):
    host = F.when(F.col("o_custkey") % 4 == 0, F.lit("https://x.com/")).otherwise(F.lit("https://a.example/"))
    records = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("url"), F.concat(host, F.col("o_custkey").cast("string"))).alias("data"))
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://a.example/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("title"), F.lit("d").alias("meta_description"), F.lit("t").alias("main_text"))
    return ex.enrich(records, pages).select("o_orderkey", "enrichment.title")


@query("""SELECT '{"k": ' || (p_partkey % 9) || ', "_source":"p' || p_partkey || '","_extractor":"x","_run":"r1"}' AS value FROM part""")
def export_jsonl(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("r1").alias("run_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_url"), F.lit("x").alias("extractor"), F.concat(F.lit('{"k": '), (F.col("p_partkey") % 9).cast("string"), F.lit("}")).alias("data"))
    return export(rows)


# ---- policy


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20 AS capped FROM events")
def domain_cap(spark, sf_dir):
    return policy.domain_cap(table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("domain")), 20).select("event_id", "capped")


@query("SELECT event_id, sum(user_id + 1) OVER (ORDER BY event_id)::BIGINT AS spent, sum(user_id + 1) OVER (ORDER BY event_id) <= 40000 AS within FROM events")
def fetch_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("seq"))
    return policy.running_budget(rows, F.col("user_id") + 1, 40_000).select("event_id", F.col("spent").cast("long").alias("spent"), "within")


@query("""SELECT event_id, i * 2.0 + max(a - i * 2.0) OVER (PARTITION BY user_id ORDER BY event_id) AS start FROM
 (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, (event_id // 50)::DOUBLE AS a FROM events)""")
def pacing_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("domain"), F.floor(F.col("event_id") / 50).cast("double").alias("arrival"), F.lit(None).cast("double").alias("delay"))
    return policy.pacing(rows).select("event_id", "start")


_SOFT = Settings(render_breaker_min=5, render_breaker_ratio=0.6)
_BREAKER = """SELECT event_id, NOT coalesce(bool_or(trip) OVER (PARTITION BY user_id ORDER BY event_id), false) AS rendered FROM
 (SELECT event_id, user_id, n >= 5 AND soft >= 0.6 * n AS trip FROM (SELECT event_id, user_id, count(*) OVER w AS n, coalesce(sum(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END) OVER w, 0) AS soft
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def attempts_of(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("domain"), F.col("event_type").isin("error", "click").alias("soft"), F.lit(False).alias("forced"))


@query(_BREAKER)
def render_breaker(spark, sf_dir):
    return policy.render_breaker(attempts_of(table(spark, sf_dir, "events")), _SOFT).select("event_id", "rendered")


@query(_BREAKER)
def render_breaker_state(spark, sf_dir):
    return policy.render_breaker_forced(attempts_of(table(spark, sf_dir, "events")), _SOFT).select("event_id", "rendered")


@query("SELECT user_id::VARCHAR AS domain, CASE event_type WHEN 'error' THEN 'domain_capped' WHEN 'click' THEN 'render_skipped' ELSE 'render_broken' END AS reason, count(*) AS n FROM events WHERE event_type IN ('error', 'click', 'view') GROUP BY ALL")
def cap_summary(spark, sf_dir):
    reason = F.when(F.col("event_type") == "error", F.lit("domain_capped")).when(F.col("event_type") == "click", F.lit("render_skipped")).when(F.col("event_type") == "view", F.lit("render_broken"))
    return policy.cap_summary(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("domain"), reason.alias("reason"))).select("domain", "reason", "n")


@query("SELECT role AS purpose, count(*) AS calls, sum(length(text) // 4)::BIGINT AS tokens_in, sum(turn)::BIGINT AS tokens_out FROM conversations GROUP BY role")
def tokens_by_purpose(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").select(F.col("role").alias("purpose"), F.floor(F.char_length("text") / 4).alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return policy.tokens_by_purpose(calls)


# ---- streams

_NAV_SQL = f"SELECT l.page_id, pos::INTEGER AS item_pos, text AS name, origin || href AS url FROM {_LINKS} l JOIN {_CANONICAL} c ON l.page_id = c.page_id"
_SQL["list_navigation"] = _NAV_SQL


def list_navigation(spark, sf_dir):
    return flagship(spark, sf_dir)


_QUERIES["list_navigation"] = list_navigation


def _landing(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _drained(stream: DataFrame) -> DataFrame:
    """The rows of a stream, by way of a folder of their own: a driver can't hold them at size."""
    return streams.drain(stream, f"{ln.shared_folder(stream.sparkSession)}/streams/{uuid.uuid4().hex}")


@query(_NAV_SQL)
def stream_extract(spark, sf_dir):
    """flagship() over a stream of page files."""
    pages = spark.readStream.schema(streams.PAGES).option("pathGlobFilter", "*.parquet").parquet(_landing(sf_dir, "pages") + "*")
    rows = _drained(streams.record_stream(pages, NAV, key="page_id", base="url", spread=spread(spark)))
    return ex.pivot(rows, ["name", "url"]).select(F.col("page_id").cast("long").alias("page_id"), "item_pos", "name", "url")


@query(_BREAKER)
def stream_breaker(spark, sf_dir):
    """render_breaker() over a stream of attempts."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(_landing(sf_dir, "events") + "*")
    rows = _drained(streams.breaker_stream(attempts_of(events).drop("event_id"), _SOFT, "long"))
    return rows.select(F.col("seq").alias("event_id"), "rendered")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20 AS capped FROM events")
def stream_cap(spark, sf_dir):
    """domain_cap() over a stream."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_landing(sf_dir, "events") + "*")
    rows = _drained(streams.cap_stream(events.select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq")), 20, "long"))
    return rows.select(F.col("seq").alias("event_id"), "capped")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
