"""Fetching pages: the decisions are DataFrame operators, only transport runs in workers.

A request passes, in this order: canonical form, deny list, cache, cap of its
domain, robots rules, budget, its turn in the domain's pace, transport, health, and
perhaps a render, of which the better page is kept. Requests that are refused aren't
stored. robots.txt is fetched once for each origin. Renders come in waves no longer
than the breaker could let through, so that none is made that it would have refused.
"""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.config import Settings
from pagequery.functions import health, urls
from pagequery.operators.facts import page_texts
from pagequery.operators.policy import BreakerState, cap_summary, pacing, running_budget
from pagequery.sources.store import Store

FETCHED = "url string, final_url string, status int, html string, error string"
TEXT_TYPES = ("", "text/html", "application/xhtml+xml", "application/xml", "text/xml", "text/plain")


class Transport(Protocol):
    """Anything that gets one address: (final_url, status, content_type, body, error); it is sent to the workers.

    One without an attribute remote, or with a true one, is paced.
    """

    def get(self, url: str) -> tuple[str, int | None, str, str | None, str | None]: ...


class HttpTransport:
    """Plain HTTP by the standard library; redirects are followed."""

    def __init__(self, timeout: int = 20, agent: str = "Mozilla/5.0 (compatible; pagequery)"):
        self.timeout, self.agent = timeout, agent

    def get(self, url: str):
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                return r.geturl(), r.status, r.headers.get_content_type(), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            return e.geturl() or url, e.code, e.headers.get_content_type() if e.headers else "", e.read().decode("utf-8", "replace"), None
        except Exception as e:  # noqa: BLE001  whatever a network does becomes the row's error
            return url, None, "", None, f"{type(e).__name__}: {e}"[:300]


class TableTransport:
    """Pages of a fixed dictionary {url: html or (status, html)}, for tests and dry runs; others are 404."""

    remote = False

    def __init__(self, pages: dict):
        self.pages = pages

    def get(self, url: str):
        found = self.pages.get(url)
        if found is None:
            return url, 404, "text/html", "<title>Not here</title>", None
        status, html = found if isinstance(found, tuple) else (200, found)
        return url, status, "text/html", html, None


def get_all(requests: DataFrame, transport: Transport) -> DataFrame:
    """FETCHED rows of requests (url, and for paced ones domain, start and gap). Bodies that aren't text are dropped.

    A paced address isn't asked for before start (seconds since 1970), nor within gap
    seconds of the one before it of its domain, which is in the same task.
    """
    names = ["url", *(c for c in ("domain", "start", "gap") if "gap" in requests.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if "gap" in r:
                    time.sleep(max(0.0, max(r["start"], last.get(r["domain"], 0.0) + r["gap"]) - time.time()))
                    last[r["domain"]] = time.time()
                u = r["url"]
                final, status, kind, body, error = transport.get(u)
                body = body if (kind or "").lower() in TEXT_TYPES else None
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((u, pa.string()), (final, pa.string()), (status, pa.int32()), (body, pa.string()), (error, pa.string()))], ["url", "final_url", "status", "html", "error"])

    return requests.select(*names).mapInArrow(run, FETCHED)


def classified(fetched: DataFrame) -> DataFrame:
    """fetched with health, from the status, the html and its main text."""
    keep = F.col("html").alias("_html")
    read = page_texts(fetched.select("*", keep)).drop("title", "headings").withColumnRenamed("_html", "html")
    return read.withColumn("health", F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(health.classify(F.col("status"), F.col("html"), F.col("main_text")))).drop("main_text")


def robots_allowed(requests: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """requests (url, ...) with robots_ok and crawl_delay, from robots (origin, body); a missing or null body allows all.

    The rules of an origin join its requests once; a request's rules are parsed in the worker, once for each run of one origin.
    """
    origin = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*", 0)
    joined = requests.withColumn("_origin", origin).join(robots.select(F.col("origin").alias("_origin"), F.col("body").alias("_body")), "_origin", "left")
    names = requests.columns
    schema = requests.withColumn("robots_ok", F.lit(True)).withColumn("crawl_delay", F.lit(None).cast("double")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rules = None, None
        for batch in batches:
            ok, delay = [], []
            for u, o, body in zip(batch["url"].to_pylist(), batch["_origin"].to_pylist(), batch["_body"].to_pylist(), strict=True):
                if not body:
                    ok.append(True)
                    delay.append(None)
                    continue
                if o != seen:
                    seen, rules = o, RobotFileParser()
                    rules.parse(body.splitlines())
                    rules.modified()
                ok.append(rules.can_fetch(agent, u))
                delay.append(float(rules.crawl_delay(agent)) if rules.crawl_delay(agent) is not None else None)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(ok, pa.bool_()), pa.array(delay, pa.float64())], [*names, "robots_ok", "crawl_delay"])

    return joined.mapInArrow(run, schema)


class Fetcher:
    """Fetches addresses through a store's cache, under a policy; one object for each invocation, whose counts it keeps.

    robots is a table (origin, body) of rules known beforehand; other origins' are
    fetched when first needed and kept. notice is told when a domain's breaker trips.
    """

    def __init__(self, store: Store, transport: Transport, renderer: Transport | None = None, settings: Settings = Settings(), robots: DataFrame | None = None, notice: Callable[[str], None] = lambda s: None):
        self.store, self.transport, self.renderer, self.settings, self.notice = store, transport, renderer, settings, notice
        self.spark: SparkSession = store.spark
        self.fetches = self.renders = self.cache_hits = 0
        self.by_domain: dict[str, int] = {}
        #: rules by origin, null for none; what is known beforehand is a table of any size
        self.known_robots, self.robots = robots, {}
        #: when a domain may be asked next, and its renders so far
        self.free_at: dict[str, float] = {}
        self.gaps: dict[str, float] = {}
        self.breakers: dict[str, BreakerState] = {}
        self.outcomes: Counter = Counter()

    def requests(self, addresses: list[str]) -> DataFrame:
        """(seq, url, domain): canonical addresses, once each in the order given."""
        raw = self.spark.createDataFrame(list(enumerate(addresses)), "seq long, raw string").withColumn("url", urls.canonical(F.col("raw")))
        return raw.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("seq").alias("seq")).withColumn("domain", urls.domain(F.col("url")))

    def plan(self, requests: DataFrame, *, refresh: bool = False) -> DataFrame:
        """requests with decision (denied, cached, domain_capped, robots_disallowed, over_budget or fetch) and crawl_delay."""
        s = self.settings
        known = self.store.cached(requests.select("url"), s.max_age_days).filter(F.col("fetched_at").isNotNull()).select("url", F.col("health").alias("_old"))
        shell = F.col("_old").isin(*health.RETRY_WITH_BROWSER) & F.lit(self.renderer is not None)
        rows = requests.join(known, "url", "left").withColumn("_denied", urls.denied(F.col("url")))
        rows = rows.withColumn("_cached", F.col("_old").isNotNull() & ~shell & F.lit(not refresh)).drop("_old")
        rows = robots_allowed(rows, self.rules(rows.filter(~F.col("_denied") & ~F.col("_cached")))) if s.respect_robots else rows.withColumn("robots_ok", F.lit(True)).withColumn("crawl_delay", F.lit(None).cast("double"))
        used = F.coalesce(*[F.when(F.col("domain") == d, F.lit(n)) for d, n in self.by_domain.items()], F.lit(0)) if self.by_domain else F.lit(0)
        open_ = ~F.col("_denied") & ~F.col("_cached")
        before = F.sum((open_ & F.col("robots_ok")).cast("long")).over(Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_capped", open_ & (F.coalesce(before, F.lit(0)) + used >= s.cap_per_domain))
        new = open_ & ~F.col("_capped") & F.col("robots_ok")
        rows = running_budget(rows.withColumn("_new", new), F.col("_new").cast("long"), s.budget_fetches - self.fetches)
        decision = (
            F.when(F.col("_denied"), F.lit("denied")).when(F.col("_cached"), F.lit("cached")).when(F.col("_capped"), F.lit("domain_capped"))
            .when(~F.col("robots_ok"), F.lit("robots_disallowed")).when(~F.col("within"), F.lit("over_budget")).otherwise(F.lit("fetch"))
        )
        return rows.select("seq", "url", "domain", decision.alias("decision"), "crawl_delay")

    def rules(self, requests: DataFrame) -> DataFrame:
        """(origin, body) for the origins of requests: what was known beforehand, else what their robots.txt says, asked for once."""
        origins = requests.select(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*", 0).alias("origin")).distinct()
        given = self.known_robots.select("origin", "body") if self.known_robots is not None else self.spark.createDataFrame([], "origin string, body string")
        # the addresses of one call are a list of its caller's, and so are their origins
        new = [r.origin for r in origins.join(given, "origin", "left_anti").collect() if r.origin not in self.robots]
        if new:
            asked = self.spark.createDataFrame([(o + "/robots.txt",) for o in new], "url string").repartition(min(len(new), 64))
            found = {r.url: r.html for r in get_all(asked, self.transport).filter("status = 200").select("url", "html").collect()}
            self.robots.update({o: found.get(o + "/robots.txt") for o in new})
        return given.unionByName(self.spark.createDataFrame(list(self.robots.items()), "origin string, body string"))

    def paced(self, asked: DataFrame, transport: Transport) -> DataFrame:
        """asked (seq, url, domain, delay) with start and gap, each domain's addresses together and in turn; dealt out freely for a transport that isn't remote."""
        if not getattr(transport, "remote", True):
            return asked.repartition(min(64, self.spark.sparkContext.defaultParallelism * 4))
        free = self.spark.createDataFrame(list(self.free_at.items()), "domain string, free double")
        rows = asked.join(F.broadcast(free), "domain", "left").withColumn("arrival", F.greatest(F.lit(time.time()), F.coalesce("free", F.lit(0.0)))).drop("free")
        # the longest delay that a domain asks for holds for all of its addresses
        gap = F.greatest(F.lit(float(self.settings.min_delay)), F.coalesce(F.max("delay").over(Window.partitionBy("domain")), F.lit(0.0)))
        rows = pacing(rows, self.settings).withColumn("gap", gap).persist()
        self.free_at.update({r.domain: r.at for r in rows.groupBy("domain").agg(F.max(F.col("start") + F.col("gap")).alias("at")).collect()})
        self.gaps.update({r.domain: r.gap for r in rows.select("domain", "gap").distinct().collect()})
        return rows.repartition(64, "domain").sortWithinPartitions("start")

    def rested(self) -> None:
        """After a batch: its last requests may have been made later than planned, so each domain rests for its gap from now."""
        self.free_at.update({d: max(self.free_at[d], time.time() + gap) for d, gap in self.gaps.items()})
        self.gaps.clear()

    def summary(self) -> list[str]:
        """A line for each domain and reason for which pages or renders were left out."""
        rows = [x for x, n in self.outcomes.items() for _ in range(n)]
        return [r.message for r in cap_summary(self.spark.createDataFrame(rows, "domain string, reason string")).orderBy("domain", "reason").collect()] if rows else []

    def fetch(self, addresses: list[str], *, refresh: bool = False, force_render: bool = False, allow_render: bool = True) -> DataFrame:
        """(seq, url, final_url, domain, status, method, health, html, from_cache): a row for each address asked for."""
        planned = self.plan(self.requests(addresses), refresh=refresh)
        rows = planned.collect()  # the addresses of one call, which its caller holds as a list already
        new = [r for r in rows if r.decision == "fetch"]
        for r in new:
            self.by_domain[r.domain] = self.by_domain.get(r.domain, 0) + 1
        self.fetches += len(new)
        self.cache_hits += sum(r.decision == "cached" for r in rows)
        self.outcomes.update((r.domain, "domain_capped") for r in rows if r.decision == "domain_capped")
        if new:
            asked = self.spark.createDataFrame([(r.seq, r.url, r.domain, r.crawl_delay) for r in new], "seq long, url string, domain string, delay double")
            got = classified(get_all(self.paced(asked, self.transport), self.transport)).withColumn("method", F.lit("http"))
            got = asked.select("seq", "url", "domain").join(got, "url").withColumn("fetched_at", F.current_timestamp())
            got = self._rendered(got, asked, force_render) if self.renderer is not None and allow_render else got
            self.store.save_pages(got)
            self.rested()
        every = self.spark.createDataFrame([tuple(r) for r in rows], planned.schema).drop("crawl_delay")
        pages = self.store.pages(every).drop("domain", "content_hash", "fetched_at")
        out = every.join(pages, "url", "left")
        refused = ~F.col("decision").isin("cached", "fetch")
        return out.select(
            "seq", "url", F.coalesce("final_url", "url").alias("final_url"), "domain", "status", "method",
            F.when(refused, F.col("decision")).otherwise(F.col("health")).alias("health"), F.when(~refused, F.col("html")).alias("html"), (F.col("decision") == "cached").alias("from_cache"),
        )

    def _wave(self, domain: str, left: int) -> int:
        """How many of left renders of a domain can be made before its breaker could trip, were all of them gone; 0 if it has."""
        s, state = self.settings, self.breakers.setdefault(domain, BreakerState(self.settings.render_breaker_min, self.settings.render_breaker_ratio))
        if not s.render_breaker:
            return left
        if state.n >= s.render_breaker_min and state.soft >= s.render_breaker_ratio * state.n:
            return 0
        most = s.render_breaker_min - state.n
        if s.render_breaker_ratio < 1:
            most = max(most, math.ceil((s.render_breaker_ratio * state.n - state.soft) / (1 - s.render_breaker_ratio)))
        return min(left, max(1, most)) if s.render_breaker_ratio <= 1 else left

    def _rendered(self, got: DataFrame, asked: DataFrame, force: bool) -> DataFrame:
        """Pages with renders of those that look like shells, where budget and breaker allow; the better of both is kept.

        Forced renders pass the breaker, and count for it.
        """
        got = got.persist()
        shells = got if force else got.filter(F.col("health").isin(*health.RETRY_WITH_BROWSER))
        want = shells.select("seq", "url", "domain").join(asked.select("url", "delay"), "url").orderBy("seq").collect()  # of one call's addresses
        made: DataFrame | None = None
        while want:
            turns: Counter = Counter(r.domain for r in want)
            room = {d: n if force else self._wave(d, n) for d, n in turns.items()}
            for d in [d for d, n in room.items() if not n]:
                if (d, "render_broken") not in self.outcomes:
                    self.notice(f"{d}: {self.breakers[d].soft} of {self.breakers[d].n} rendered pages were gone; its further shells stay as they are")
                self.outcomes[d, "render_broken"] += turns[d]
            want, wave = [r for r in want if room[r.domain]], []
            for r in want:
                if room[r.domain] > 0:
                    room[r.domain] -= 1
                    wave.append(r)
            free = self.settings.budget_renders - self.renders
            if free < len(wave):
                # those beyond the budget, and all that would follow, stay shells
                self.outcomes.update((r.domain, "render_skipped") for r in want if r not in wave[:free])
                want = wave = wave[:free]
            if not wave:
                break
            rows = self.spark.createDataFrame([(r.seq, r.url, r.domain, r.delay) for r in wave], "seq long, url string, domain string, delay double")
            new = rows.select("url", "domain").join(classified(get_all(self.paced(rows, self.renderer), self.renderer)), "url").persist()
            for r in new.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("health") == "soft_404").alias("soft")).collect():
                state = self.breakers.setdefault(r.domain, BreakerState(self.settings.render_breaker_min, self.settings.render_breaker_ratio))
                state.n, state.soft = state.n + r.n, state.soft + r.soft
            self.rested()
            self.renders += len(wave)
            made = new if made is None else made.unionByName(new)
            gone = {r.url for r in wave}
            want = [r for r in want if r.url not in gone]
        if made is None:
            return got
        new = made.select("url", F.struct("health", "html", "status", "final_url", F.lit("browser").alias("method")).alias("_b"))
        old = F.struct("health", "html", "status", "final_url", "method")
        best = F.when(F.col("_b").isNull(), old).otherwise(health.better(old, F.col("_b")))
        out = got.join(new, "url", "left").withColumn("_x", best)
        return out.select("seq", "url", "domain", "fetched_at", "_x.*")
