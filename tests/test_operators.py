"""Facts, links, extraction, policy, store, fetching, engine and streams over small made-up sites."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pagequery.config import Settings
from pagequery.functions import dom
from pagequery.operators import extract as ex
from pagequery.operators import facts as fx
from pagequery.operators import links as ln
from pagequery.operators import policy
from pagequery.plans.engine import Engine
from pagequery.plans.model import BudgetExceeded, Meter, Model
from pagequery.plans.program import validate
from pagequery.sources import sitemaps
from pagequery.sources.fetch import Fetcher, TableTransport, robots_allowed
from pagequery.sources.store import Store, lines

BASE = "https://site.example"
NAMES = [f"Company {i}" for i in range(18)]
TEXT = "Some words about this company and what it does, at length. " * 20


def card(i):
    return f'<div class="company-card"><h3><a href="/companies/c{i}-x">{NAMES[i]}</a></h3><p class="blurb">Blurb {i}</p></div>'


def site():
    nav = '<nav><a href="/">Home</a><a href="/about">About</a></nav>'
    pages = {
        BASE + "/": f"<html><head><title>Hub</title></head><body>{nav}<main><p>{TEXT}</p><a href='/list/all'>All companies</a></main><footer><a href='https://www.linkedin.com/company/x'>in</a></footer></body></html>",
        BASE + "/list/all": f"<html><body>{nav}<main><p>{TEXT}</p>{''.join(map(card, range(12)))}<a rel=next href='/list/all?page=2'>2</a></main></body></html>",
        BASE + "/list/all?page=2": f"<html><body>{nav}<main><p>{TEXT}</p>{''.join(map(card, range(12, 18)))}</main></body></html>",
        BASE + "/product": '<html><head><script type="application/ld+json">{"@type":"Product","name":"Lamp","offers":{"price":9.5,"priceCurrency":"EUR"}}</script></head><body><main>' + TEXT + "</main></body></html>",
        BASE + "/robots.txt": f"User-agent: *\nDisallow: /private\nSitemap: {BASE}/sitemap.xml",
        BASE + "/sitemap.xml": f"<sitemapindex><sitemap><loc>{BASE}/map1.xml</loc></sitemap></sitemapindex>",
        BASE + "/map1.xml": "<urlset>" + "".join(f"<url><loc>{BASE}/companies/c{i}-x</loc></url>" for i in range(18)) + f"<url><loc>{BASE}/about</loc></url></urlset>",
    }
    for i in range(18):
        pages[f"{BASE}/companies/c{i}-x"] = f"<html><body>{nav}<main><h1>{NAMES[i]}</h1><p class='desc'>{TEXT} Number {i}.</p><a class='site' href='https://c{i}.example/'>site</a></main></body></html>"
    return pages


DETAIL = {"kind": "detail", "fields": {"name": {"sel": "h1", "attr": "text"}, "site": {"sel": "a.site", "attr": "href"}}}


class Scripted:
    """A backend that answers by the kind of question."""

    def __init__(self, plans):
        self.plans, self.asked = list(plans), []

    def ask(self, prompt, system, max_tokens):
        self.asked.append(system)
        if system == "plan":
            return json.dumps(self.plans.pop(0) if self.plans else {"steps": [{"do": "done"}]}), 300, 30
        hub = "All companies" in prompt
        return (json.dumps(DETAIL), 800, 80) if system == "spec" else (json.dumps({"records": [] if hub else [{"name": "read"}], "needs_navigation": hub}), 300, 30)


PLAN = {"steps": [
    {"do": "fetch", "urls": [BASE + "/list/all", BASE + "/invented"]}, {"do": "fetch_group", "from": "prev", "group": "site.example/companies/*", "cap": 99, "paginate": True},
    {"do": "extract", "from": "prev"}, {"do": "enrich", "from": "prev"}, {"do": "nonsense"}, {"do": "done", "reason": "all read"},
]}


def test_run_of_a_site_and_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    model = Scripted([PLAN])
    report = Engine(store, Fetcher(store, TableTransport(site())), Model(model)).run("all companies", [BASE + "/"], ["name", "site"])
    assert (report["state"], report["records"], report["specs_made"]) == ("done", 18, 1)
    assert len(report["clamps"]) == 4 and model.asked.count("spec") == 1 and model.asked.count("read") == 1  # the start page alone
    data = [json.loads(r.data) for r in store.records(report["run_id"]).collect()]
    assert {d["name"] for d in data} == set(NAMES) and {d["site"] for d in data} == {f"https://c{i}.example/" for i in range(18)}
    again = Scripted([PLAN])
    second = Engine(store, Fetcher(store, TableTransport({})), Model(again)).run("all companies", [BASE + "/"], ["name", "site"])
    assert (second["records"], second["fetches"], again.asked.count("spec")) == (18, 0, 0) and second["cache_hits"] >= 20
    assert [r.run_id for r in store.runs().collect()][0] == second["run_id"] and json.loads(store.run(second["run_id"]).report)["records"] == 18
    assert all(json.loads(x)["_run"] == second["run_id"] for x in lines(store.records(second["run_id"])))


def test_structured_data_needs_no_model(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    report = Engine(store, Fetcher(store, TableTransport(site()))).run("the product", [BASE + "/product"], ["name", "price", "currency"])
    assert (report["state"], report["records"], report["model_calls"]) == ("done", 1, 0)
    assert json.loads(store.records(report["run_id"]).first().data) == {"name": "Lamp", "price": "9.5", "currency": "EUR"}


def test_fetch_decisions_and_caps(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    addresses = [f"{BASE}/companies/c{i}-x" for i in range(5)]
    tight = Fetcher(store, TableTransport(site()), settings=Settings(cap_per_domain=3))
    got = {r.url: r.health for r in tight.fetch([*addresses, "https://x.com/a", "mailto:a@b", addresses[0] + "#again"]).collect()}
    assert sorted(got.values()) == ["denied", "domain_capped", "domain_capped", "ok", "ok", "ok"]
    assert {r.health for r in Fetcher(store, TableTransport(site()), settings=Settings(cap_per_domain=3)).fetch(addresses).collect()} == {"ok"}
    robots = spark.createDataFrame([(BASE, site()[BASE + "/robots.txt"] + "\nCrawl-delay: 5")], "origin string, body string")
    rules = {r.url: r for r in robots_allowed(spark.createDataFrame([(BASE + "/private/x",), (BASE + "/a",), ("https://o.example/",)], "url string"), robots).collect()}
    assert [rules[u].robots_ok for u in (BASE + "/private/x", BASE + "/a", "https://o.example/")] == [False, True, True]
    refused = Fetcher(store, TableTransport(site()), robots=robots).fetch([BASE + "/private/x"]).first()
    assert refused.health == "robots_disallowed" and store.pages().filter(F.col("url").contains("private")).count() == 0


def test_renders_and_cache_heal(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    shells = {f"{BASE}/s{i}/x": '<html><body><div id="root"></div></body></html>' for i in range(14)}
    dead = {u: "<title>Page not found</title><main>" + TEXT + "</main>" for u in shells}
    f = Fetcher(store, TableTransport(shells), TableTransport(dead))
    got = f.fetch(list(shells)).collect()
    assert (f.renders, sum(r.method == "browser" for r in got)) == (10, 10)
    live = {u: "<main>" + TEXT + "</main>" for u in shells}
    healed = Fetcher(store, TableTransport(shells), TableTransport(live)).fetch(list(shells)).collect()
    assert sum(r.health == "ok" for r in healed) == 4 and sum(r.from_cache for r in healed) == 10
    none = Store(spark, f"file://{tmp_path}/other")
    assert {r.health for r in Fetcher(none, TableTransport(shells), TableTransport(live), Settings(budget_renders=0)).fetch(list(shells)[:2]).collect()} == {"js_shell"}


class Counted(TableTransport):
    """Writes a line for each call, as workers share no memory with the test."""

    def __init__(self, pages, path, remote=False):
        super().__init__(pages)
        self.path, self.remote = path, remote

    def get(self, url):
        with open(self.path, "a") as f:
            f.write(f"{time.time()} {url}\n")
        return super().get(url)

    def calls(self):
        return [(float(x.split()[0]), x.split()[1]) for x in open(self.path)] if os.path.exists(self.path) else []


def test_renders_that_the_breaker_refuses_are_not_made(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    shells = {f"{BASE}/s{i}/x": '<html><body><div id="root"></div></body></html>' for i in range(14)}
    dead = Counted({u: "<title>Page not found</title><main>" + TEXT + "</main>" for u in shells}, f"{tmp_path}/renders")
    said = []
    f = Fetcher(store, TableTransport(shells), dead, notice=said.append)
    f.fetch(list(shells)).count()
    assert len(dead.calls()) == f.renders == 10 and len(said) == 1 and "10 of 10" in said[0]
    assert f.summary() == ["site.example: 4 renders not made, most pages there are gone"]
    f.fetch([f"{BASE}/s12/x"]).count()  # the breaker stays open in later calls
    assert len(dead.calls()) == 10
    half = Counted({u: ("<title>Page not found</title><main>" if i % 2 else "<main>") + TEXT + "</main>" for i, u in enumerate(shells)}, f"{tmp_path}/half")
    Fetcher(Store(spark, f"file://{tmp_path}/other"), TableTransport(shells), half).fetch(list(shells)).count()
    assert len(half.calls()) == 14
    few = Fetcher(Store(spark, f"file://{tmp_path}/few"), TableTransport(shells), half, Settings(budget_renders=3))
    few.fetch(list(shells)).count()
    assert len(half.calls()) == 17 and few.summary() == ["site.example: 11 renders beyond the budget"]


def test_robots_are_fetched_once_and_pages_paced(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    web = Counted(site() | {BASE + "/robots.txt": "User-agent: *\nDisallow: /private\nCrawl-delay: 1", "https://o.example/a/b": "<p>" + TEXT}, f"{tmp_path}/calls", remote=True)
    f = Fetcher(store, web, settings=Settings(min_delay=0.1))
    got = {r.url: r.health for r in f.fetch([BASE + "/private/x", *(f"{BASE}/companies/c{i}-x" for i in range(4)), "https://o.example/a/b"]).collect()}
    assert got[BASE + "/private/x"] == "robots_disallowed" and sum(h == "ok" for h in got.values()) == 5
    f.fetch([f"{BASE}/companies/c{i}-x" for i in range(4, 6)]).count()
    calls = web.calls()
    assert [u for _, u in calls].count(BASE + "/robots.txt") == 1 and not any("private" in u for _, u in calls)
    times = sorted(t for t, u in calls if "/companies/" in u)
    assert len(times) == 6 and all(b - a > 0.98 for a, b in zip(times, times[1:]))
    rude = Fetcher(Store(spark, f"file://{tmp_path}/rude"), web, settings=Settings(min_delay=0.0, respect_robots=False))
    rude.fetch([BASE + "/private/x"]).count()
    assert web.calls()[-1][1] == BASE + "/private/x"


def test_prompts_name_every_key_that_is_read():
    from pagequery.plans import program

    said = program.plan_prompt("o", ["f"], {}, [])
    assert all(f'"{k}"' in said for k in ("steps", "do", "urls", "from", "group", "cap", "paginate", "fields", "mode", "url_field", "reason", *program.KINDS, "start", "prev"))
    assert all(f'"{k}"' in program.spec_prompt(["f"], [], "") for k in ("kind", "fields", "item_selector", "island_selector", "path", "sel", "attr", *ex.KINDS))
    assert all(f'"{k}"' in program.read_prompt(["f"], "", "", []) for k in ("records", "needs_navigation"))
    assert validate({"steps": [{"do": "extract"}]}, {"start"}, set(), ["f"]).steps[0].source == "start"


def test_sitemaps(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    f = Fetcher(store, TableTransport(site()))
    found, read, left = sitemaps.discover(spark, lambda us: f.fetch(us).select("url", "html"), BASE + "/x")
    assert found.count() == 19 and len(read) == 2 and not left
    assert [(r.pattern, r.n) for r in ln.site_patterns(found).collect()] == [("site.example/companies/*", 18), (BASE + "/about", 1)]
    assert sitemaps.matching(found, "about").count() == 1


def test_links_groups_and_rest(spark):
    body = "".join(f'<a href="/item/a{i}">I{i}</a>' for i in range(12)) + "".join(f'<a href="https://linkedin.com/in/p{i}">d</a>' for i in range(5)) + "".join(f'<a href="https://other.example/p/q{i}">o</a>' for i in range(5))
    html = f"<html><body><main>{body}<a href='/item/a0'><img alt='pic'></a></main><footer>{''.join(f'<a href=/f{i}>f{i}</a>' for i in range(60))}<a href='#x'></a></footer></body></html>"
    pages = fx.page_facts(spark.createDataFrame([("https://h.com/p", html)], "url string, html string"))
    rows = ln.link_rows(pages).cache()
    groups = [(r.id, r["count"], r.external, r.region) for r in ln.link_groups(rows).orderBy("place").collect()]
    assert groups == [("h.com/item/*", 12, False, "main"), ("other.example/p/*", 5, True, "main")]
    singles = ln.single_links(rows)
    assert (singles.filter("shown").count(), singles.count()) == (40, 61)  # the page itself is a link too
    assert ln.omitted_counts(singles).first().by_region == {"footer": 21}
    assert [(r.denied, r.n) for r in ln.denied_counts(rows).collect()] == [("linkedin.com/in/*", 5)]
    assert ln.expand(rows, "h.com/item/*").count() == 12 and ln.expand(rows, "*").count() == rows.count() - 5
    grouped = sum(n for _, n, _, _ in groups)
    assert grouped + singles.count() + 5 == rows.count()
    out = ln.outline(pages.withColumn("status", F.lit(200)).withColumn("health", F.lit("ok"))).first()
    assert (out.links_total, out.omitted, out.denied) == (rows.count(), 21, {"linkedin.com/in/*": 5}) and len(out.groups) == 2


def test_facts():
    html = """<html><head><title> T </title><meta name=description content="D"><meta property="og:title" content="O"><link rel="next" href="/2"></head><body>
    <div itemscope itemtype="https://schema.org/CreativeWork"><i itemprop="author">A</i><b itemprop="text">B</b></div><h1>H</h1><h2></h2><h3>I</h3></body></html>"""
    f = fx.facts(html)
    assert (f["title"], f["meta_description"], f["headings"], dict(f["og"]), f["next_href"]) == ("T", "D", ["h1: H", "h3: I"], {"title": "O"}, "/2")
    assert f["microdata"] == {"scopes": 1, "types": ["schema.org/CreativeWork"], "props": ["author", "text"]} and fx.facts("<p>x")["microdata"] is None
    assert 'itemprop="author"' in fx.prune(html) and "<head" not in fx.prune(html) and "onclick" not in fx.prune('<body onclick="x"><svg></svg><a style="y" href="data:image/png;base64,AAAA">z</a>')
    assert fx.next_href(dom.parse('<a href="/a">›</a><a href="/b">Next page</a>')) == "/b"
    assert fx.facts(None)["main_text"] == "" and fx.shape(dom.parse("<p><p>")) == fx.shape(dom.parse("<p>x<p>y"))


def test_specs():
    island = json.dumps({"props": {"items": [{"t": f"T{i}", "w": {"url": f"/u{i}"}, "tags": ["a", i]} for i in range(8)]}, "pad": "x" * 2100})
    html = f'<div id="__next"></div><script id="__NEXT_DATA__" type="application/json">{island}</script>'
    spec = ex.Spec.read({"kind": "island", "path": "props.items", "fields": {"t": "t", "u": "w.url", "g": "tags.1"}})
    rows = ex.applier(spec)(html, "http://h.com/x")
    assert len(rows) == 8 and rows[1] == {"t": "T1", "u": "http://h.com/u1", "g": 1}
    found = fx.islands(dom.parse(html))[0]
    assert (found["selector"], found["arrays"][0]["path"], found["arrays"][0]["count"]) == ("script#__NEXT_DATA__", "props.items", 8)
    for bad in ({"kind": "island", "path": "no.where", "fields": {"t": "t"}}, {"kind": "list", "item_selector": "b.no", "fields": {"t": "t"}}, {"kind": "list", "item_selector": "p:hover", "fields": {"t": "t"}}):
        with pytest.raises(ex.SpecError):
            ex.validate(ex.Spec.read(bad), html)
    for bad in ({}, {"kind": "x", "fields": {"a": "b"}}, {"kind": "list", "fields": {}}):
        with pytest.raises(ex.SpecError):
            ex.Spec.read(bad)
    assert ex.Spec.read(ex.Spec.read(DETAIL).json()) == ex.Spec.read(DETAIL)
    assert ex.linked_record(['{"@type":"Organization","name":"x"}'], ["name"]) is None and ex.linked_record(['{"@type":"Product","name":"x"}'], ["a", "b", "c"]) is None


def test_extraction_of_odd_pages(spark):
    pages = spark.createDataFrame([("u1", None), ("u2", ""), ("u3", "<ul><li>a</li><li></li></ul>"), ("u3", "<ul><li>a</li></ul>")], "url string, html string")
    rows = ex.extract(pages, {"kind": "list", "item_selector": "li", "fields": {"x": ""}})
    assert sorted((r.url, r.item_pos, r.data["x"]) for r in rows.collect()) == [("u3", 0, "a"), ("u3", 0, "a")]
    many = spark.createDataFrame([(f"u{i}", f"<p>{i}</p>") for i in range(40)], "url string, html string")
    spec = {"kind": "detail", "fields": {"x": "p"}}
    key = lambda df: sorted((r.url, r.data["x"]) for r in df.collect())
    assert key(ex.extract(many.repartition(1), spec)) == key(ex.extract(many, spec, spread=7))


def test_output_health(spark):
    rows = spark.createDataFrame([({"name": None, "b": "x"},)] * 5, "data map<string,string>")
    assert ex.output_health(rows, ["name", "b"]).first().problems == ["name is mostly null"]
    none = ex.output_health(rows.limit(0), ["name"]).first()
    assert (none.records, none.ok) == (0, False)
    fine = spark.createDataFrame([({"name": str(i), "b": "x"},) for i in range(5)], "data map<string,string>")
    assert ex.output_health(fine, ["name", "b"]).first().ok and ex.output_health(fine, ["name"], expected=F.lit(20)).first().problems == ["fewer records than expected"]


def breaker(spark, soft, forced=None, **settings):
    rows = [(i, "d", s, bool(forced and i in forced)) for i, s in enumerate(soft)]
    df = spark.createDataFrame(rows, "seq long, domain string, soft boolean, forced boolean")
    s = Settings(**settings)
    return [[r.rendered for r in f(df, s).orderBy("seq").collect()] for f in ((policy.render_breaker_forced,) if forced else (policy.render_breaker, policy.render_breaker_forced))]


def test_render_breaker(spark):
    for got in breaker(spark, [True] * 14):
        assert got == [True] * 10 + [False] * 4
    for got in breaker(spark, [True, False] * 7) + breaker(spark, [True] * 14, render_breaker=False):
        assert got == [True] * 14
    assert breaker(spark, [True] * 14, forced={12})[0] == [True] * 10 + [False, False, True, False]


def test_budgets_over_ranges(spark):
    rows = spark.createDataFrame([(i * i, i % 3) for i in range(50)], "seq long, n long")
    for blocks in (1, 7, 1024):
        got = [r.spent for r in policy.running_budget(rows, F.col("n"), 30, blocks=blocks).orderBy("seq").collect()]
        assert got == [sum(j % 3 for j in range(i + 1)) for i in range(50)]
    assert policy.running_budget(rows.limit(0), F.col("n"), 3).count() == 0


def test_budgets_and_caps_of_domains_over_ranges(spark):
    given = [(i, "a" if i % 3 else (None if i % 2 else "b"), i) for i in range(50)]
    rows = spark.createDataFrame(given, "seq long, domain string, n long")
    for blocks in (1, 7, 1024):
        got = {r.seq: (r.spent, r.within) for r in policy.running_budget(rows, F.col("n"), 30, by="domain", blocks=blocks).collect()}
        spent = {i: sum(n for j, other, n in given if other == d and j <= i) for i, d, _ in given}
        assert got == {i: (n, n <= 30) for i, n in spent.items()}
    capped = {r.seq: r.capped for r in policy.domain_cap(rows, 5, counts=F.col("n") % 2 == 0).collect()}
    assert capped == {i: i % 2 == 0 and sum(d == other and j % 2 == 0 for j, other, _ in given if j <= i) > 5 for i, d, _ in given}
    assert policy.domain_cap(rows.limit(0), 5).columns == ["seq", "domain", "n", "capped"]


def test_store_keeps_prunes_and_wipes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.counts() == {"pages": 0, "runs": 0, "records": 0, "extractors": 0, "events": 0} and not (tmp_path / "store").exists()
    rows = spark.createDataFrame([("a", "x", "2024-01-01 00:00:00"), ("b", "y", "2024-01-09 00:00:00"), ("c", None, None)], "url string, html string, t string")
    pages = rows.select("url", "html", F.col("t").cast("timestamp").alias("fetched_at"))
    store.save_pages(pages)
    store.save_pages(pages.filter("url = 'a'").withColumn("fetched_at", F.lit("2024-01-02 00:00:00").cast("timestamp")).withColumn("html", F.lit("z")))
    assert {r.url: r.html for r in store.pages().collect()} == {"a": "z", "b": "y", "c": None}
    assert [(r.url, r.html) for r in store.pages(rows.select("url").filter("url = 'a'").union(rows.select(F.lit("none")))).collect()] == [("a", "z")]
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert {r.url for r in store.cached(rows.select("url"), 2.5, now).filter("fetched_at is not null").collect()} == {"b"}
    assert store.prune_pages(7, now) == 2 and store.counts()["pages"] == 1
    record = spark.createDataFrame([("r", "s", "e", '{"a": 1}')] * 2, "run_id string, source_url string, extractor string, data string")
    assert (store.add_records(record), store.add_records(record)) == (1, 0)
    seq = store.records("r").first().seq
    store.update_records(spark.createDataFrame([(seq, '{"a": 2}')], "seq long, data string"))
    assert [json.loads(x) for x in lines(store.records("r"))] == [{"a": 2, "_source": "s", "_extractor": "e", "_run": "r"}]
    spec = spark.createDataFrame([("d", "t", "f", "{}", True)], "domain string, template string, fields string, spec string, healthy boolean")
    for _ in range(2):
        store.save_specs(spec)
    store.save_specs(spec.withColumn("spec", F.lit("{1}")))
    assert store.specs().first().version == 2
    store.log("r", "probe", {"n": 1})
    store.compact()
    assert store.wipe() == {"pages": 1, "runs": 0, "records": 1, "extractors": 3, "events": 1} and store.counts()["pages"] == 0


def test_plans_are_clamped():
    steps = lambda *s: validate({"steps": list(s)}, {"start"}, {"u1"}, ["f"], Settings(allow_external=True))
    assert [s.kind for s in steps({"do": "fetch", "urls": ["u1", 5]}, {"do": "extract", "from": "prev"}, {"do": "done"}, {"do": "extract"}).steps] == ["fetch", "extract", "done"]
    assert not steps({"do": "fetch", "urls": ["u2"]}).steps and not steps({"do": "extract", "from": "b9"}).steps
    lowered = steps({"do": "fetch_group", "from": "start", "cap": "x"}, {"do": "fetch_group", "from": "start", "cap": 900})
    assert [s.cap for s in lowered.steps] == [30, 30] and lowered.clamps == ["cap lowered from 900 to 30"]
    assert steps({"do": "extract", "from": "start", "mode": "odd"}).steps[0].mode == "auto" and len(steps(*[{"do": "extract", "from": "start"}] * 9).steps) == 6
    assert steps({"do": "enrich", "from": "start"}).steps[0].url_field == "url" and not validate(None, set(), set(), []).steps


def test_meter_stops_at_its_budget():
    model = Model(Scripted([]), Meter(budget_tokens=300))
    model.ask("x", "plan", "plan")
    with pytest.raises(BudgetExceeded):
        model.ask("x", "plan", "plan")
    assert model.meter.by_purpose == {"plan": (300, 30)}


def test_command_line(spark, tmp_path):
    import io

    from pagequery.cli import main

    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps(DETAIL))

    def run(*args):
        out = io.StringIO()
        assert main(["--store", f"file://{tmp_path}/store", *args], spark, TableTransport(site()), out) == 0
        return out.getvalue().splitlines()

    made = io.StringIO()
    assert main(["--store", f"file://{tmp_path}/store", "synthesize", "--fields", "name,site", f"{BASE}/companies/c1-x"], spark, TableTransport(site()), made, Scripted([])) == 0
    assert ex.Spec.read(made.getvalue()) == ex.Spec.read(DETAIL) and main(["--store", f"file://{tmp_path}/store", "synthesize", "--fields", "x", BASE], spark, TableTransport({}), made) == 2
    assert len(run("extract", "--spec", str(spec), *[f"{BASE}/companies/c{i}-x" for i in range(4)])) == 4
    assert json.loads(run("probe", BASE + "/list/all")[0])["links_total"] == 15
    assert len(run("expand", BASE + "/list/all", "site.example/companies/*")) == 12
    assert json.loads(run("sitemap", BASE)[0])["urls"] == 19
    assert json.loads(run("status")[0])["counts"]["pages"] >= 5 and json.loads(run("prune", "--days", "5")[0]) == {"deleted": 0}


def test_stream_into_store(spark, tmp_path):
    from pagequery.streaming import streams

    spark.createDataFrame([(i, f"{BASE}/companies/c{i}-x", site()[f"{BASE}/companies/c{i}-x"]) for i in range(6)], streams.PAGES).repartition(3).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    for n in (1, 2):
        pages = streams.page_stream(spark, f"{tmp_path}/in", files_per_trigger=1)
        streams.into_store(streams.record_stream(pages, DETAIL), store, "r", "detail", f"{tmp_path}/check{n}").awaitTermination()
    assert store.records("r").count() == 6


def test_stream_breaker_leaves_its_rows_in_files(spark):
    from pagequery.plans import queries as core

    for name in ("stream_breaker", "stream_extract"):
        rows = core.queries()[name](spark, "/root/testdata/sf0.001")
        assert rows.inputFiles() and rows.count() > 0  # a table in memory, which the driver holds, has no files


def test_stream_cap_leaves_its_rows_in_files(spark):
    from pagequery.plans import queries as core

    rows = core.queries()["stream_cap"](spark, "/root/testdata/sf0.001")
    assert rows.inputFiles() and rows.count() == 1000


CUT = "<html><head><title>A &amp;&amp;&amp</title></head><body><nav><a href='?a=1&copy=2'>x&lt</a></nav><article><h1>A &amp;&quot</h1><p>\ufdd0 b &amp c &quot;d&quot; &notit; &copy;<script type='application/json'>{\"a&amp\":1}</script></article></body></html>"


def test_main_text_keeps_names_without_a_semicolon():
    f = fx.facts(CUT)
    assert f["main_text"] == 'A &&quot\n\ufdd0 b &amp c "d" &notit; ©'


def test_page_titles_keep_names_without_a_semicolon():
    f = fx.facts(CUT)
    assert (f["title"], f["headings"]) == ("A &&&amp", ["h1: A &&quot"])


def test_page_outlines_keep_names_without_a_semicolon():
    f = fx.facts(CUT)
    assert [(x["href"], x["text"]) for x in f["links"]] == [("?a=1&copy=2", "x&lt")]
    assert "".join(next(n for n in dom.parse(CUT).walk() if n.tag == "script").strings()) == '{"a&amp":1}'


def test_main_text_is_whole():
    assert fx.facts("<article>" + "<p>0123456789" * 9000)["main_text"] == "\n".join(["0123456789"] * 9000)


def test_detail_spec_deals_pages_out(spark):
    from pagequery.plans import queries as core

    # a file of small rows is one task or a few, however many pages it makes
    assert core.queries()["detail_spec"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_links_and_blocks_of_passing_pages_are_those_of_trees():
    import random

    bits = ["<div class=card>", "</div>", "<li class='a b'>", "</li>", "<a href=/x>", "<a href='/y?a=1&copy=2'>", "<a>", "</a>", "<img alt=' pic '>", "<img>", "<script>", "</script>", "<nav>", "</nav>", "<div role=main>", "<p>", "<svg>", "</svg>", " some  text\n", "&amp", "<tr class=r>", "<td>", "<section class=s>", "</section>", "x " * 90, "<template>", "</template>"]
    rows = random.Random(1)
    for n in range(400):
        html = "".join(rows.choices(bits, k=rows.randint(0, 150)))
        root, read = dom.parse(html), dom.feed(fx._Passing, html)
        assert read.found_links() == [tuple(x.values()) for x in fx.links(root)]
        assert read.found_blocks() == [tuple(x.values()) for x in fx.blocks(root)]


def test_memory_of_a_large_page_is_that_of_its_links():
    import tracemalloc

    card = '<div class="card"><h3>name of it</h3><p class="d">type<p>more<a href="/parts/{}">see</a></div>'
    html = "<main>" + "".join(card.format(i) for i in range(10_000))
    tracemalloc.start()
    read = dom.feed(fx._Passing, html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(read.links) == 10_000 and read.found_blocks()[0][1] == 10_000
    assert peak < 6 * len(html)  # a tree takes some 20 times the page's text
