"""Command line: probe, expand, fetch, sitemap, text, extract, synthesize, run, export, runs, report, status, prune."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagequery.config import Settings
from pagequery.operators import extract as ex
from pagequery.operators import links as ln
from pagequery.operators.facts import page_facts, page_texts, prune
from pagequery.operators.policy import over_cap
from pagequery.plans.engine import Engine
from pagequery.plans.model import Backend, Meter, Model
from pagequery.plans.program import spec_prompt
from pagequery.sources import sitemaps
from pagequery.sources.fetch import Fetcher, HttpTransport, Transport
from pagequery.sources.store import Store, lines


def default_store() -> str:
    """A folder for caches of this system's user."""
    home = Path.home()
    base = Path(os.environ.get("LOCALAPPDATA", home)) if sys.platform == "win32" else home / "Library/Caches" if sys.platform == "darwin" else Path(os.environ.get("XDG_CACHE_HOME", home / ".cache"))
    return str(base / "pagequery")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequery")
    p.add_argument("--store", default=default_store())
    p.add_argument("--max-age", type=float, default=7.0)
    p.add_argument("--cap-per-domain", type=int, default=80)
    p.add_argument("--cap-pages", type=int, default=300)
    p.add_argument("--cap-paginate", type=int, default=3)
    p.add_argument("--ignore-robots", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("probe", "text"):
        sub.add_parser(name).add_argument("url")
    x = sub.add_parser("expand")
    x.add_argument("url")
    x.add_argument("group")
    sub.add_parser("fetch").add_argument("urls", nargs="+")
    x = sub.add_parser("sitemap")
    x.add_argument("site")
    x.add_argument("--filter")
    x = sub.add_parser("extract")
    x.add_argument("urls", nargs="+")
    x.add_argument("--spec", required=True)
    x = sub.add_parser("run")
    x.add_argument("objective")
    x.add_argument("urls", nargs="+")
    x.add_argument("--fields", default="")
    x = sub.add_parser("synthesize")
    x.add_argument("urls", nargs="+")
    x.add_argument("--fields", required=True)
    for name in ("export", "report"):
        sub.add_parser(name).add_argument("--run", required=True)
    sub.add_parser("runs")
    sub.add_parser("status")
    sub.add_parser("prune").add_argument("--days", type=float, required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, transport: Transport | None = None, out=None, backend: Backend | None = None) -> int:
    args, out = parser().parse_args(argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("pagequery").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = Settings(max_age_days=args.max_age, cap_per_domain=args.cap_per_domain, cap_pages_run=args.cap_pages, cap_paginate=args.cap_paginate, respect_robots=not args.ignore_robots)
    store = Store(spark, args.store)
    warn = lambda x: print(x, file=sys.stderr)
    fetcher = Fetcher(store, transport or HttpTransport(settings.request_timeout), settings=settings, notice=warn)
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str), file=out)
    if args.command in ("probe", "expand", "text"):
        page = fetcher.fetch([args.url]).persist()
        if args.command == "probe":
            for (x,) in ln.outline(page_facts(page.select("url", "status", "health", "html")), settings).select(F.to_json(F.struct("*"))).collect():
                say(x)
        elif args.command == "text":
            for r in page_texts(page.select("url", "html")).collect():
                say(r.main_text or "")
        else:
            for r in ln.expand(ln.link_rows(page_facts(page.select("url", "html"))), args.group).orderBy("pos").toLocalIterator():
                say(f"{r.link}\t{r.text}")
    elif args.command == "fetch":
        asked = fetcher.requests(args.urls)
        for r in over_cap(asked, settings.cap_per_domain).collect():
            print(f"{r.domain}: {r.n} addresses are more than the cap of {settings.cap_per_domain}", file=sys.stderr)
        for r in fetcher.fetch(args.urls).select("url", "health", "status", "from_cache").orderBy("url").collect():
            say(r.asDict())
    elif args.command == "sitemap":
        found, read, left = sitemaps.discover(spark, lambda us: fetcher.fetch(us).select("url", "html"), args.site)
        found = sitemaps.matching(found, args.filter).persist()
        say({"urls": found.count(), "files": read, "unread": len(left)})
        for r in ln.site_patterns(found).collect():
            say(f"{r.n}\t{r.pattern}")
    elif args.command == "extract":
        spec = ex.Spec.read(Path(args.spec).read_text())
        pages = fetcher.fetch(args.urls, allow_render=False).persist()
        sample = pages.filter("html is not null").orderBy("seq").first()
        if sample:
            ex.validate(spec, sample.html)
        for r in ex.extract(pages, spec, base="final_url").select("url", F.to_json("data").alias("data")).toLocalIterator():
            say({**json.loads(r.data), "_source": r.url})
    elif args.command == "run":
        say(Engine(store, fetcher, Model(backend, Meter(settings.budget_tokens)) if backend else None, settings).run(args.objective, args.urls, [f for f in args.fields.split(",") if f]))
    elif args.command == "export":
        for x in lines(store.records(args.run)):
            say(x)
    elif args.command == "report":
        row = store.run(args.run)
        say(row.report if row and row.report else "no such run")
    elif args.command == "runs":
        for r in store.runs().collect():
            say(r.asDict())
    elif args.command == "status":
        say({"counts": store.counts(), "pages_by_health": {r.health: r["count"] for r in store.pages_by_health().collect()}})
    elif args.command == "synthesize":
        if backend is None:
            warn("synthesize needs a model: call main() with a backend")
            return 2
        pages = fetcher.fetch(args.urls, allow_render=False).filter("html is not null").orderBy("seq").collect()  # samples, two of which are shown to the model
        made = ex.Spec.read(Model(backend).ask_json(spec_prompt([f for f in args.fields.split(",") if f], [prune(p.html, settings.synth_html_cap) for p in pages[:2]], ""), "spec", "synthesize"))
        for p in pages[:1]:
            ex.validate(made, p.html)
        say(json.loads(made.json()))
    else:
        say({"deleted": store.prune_pages(args.days)})
    for line in fetcher.summary():
        warn(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())


