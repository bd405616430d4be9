"""The autonomous run: probe, plan, execute for a few cycles, report.

The driver holds batches (lists of addresses, bounded by the caps), outlines for the
planner and counts; pages, links and records stay DataFrames.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequery.config import Settings
from pagequery.functions import health, urls
from pagequery.operators import extract as ex
from pagequery.operators import links as ln
from pagequery.operators.facts import page_facts, prune
from pagequery.operators.policy import first_per
from pagequery.plans.model import BudgetExceeded, Model
from pagequery.plans.program import Program, Step, plan_prompt, read_prompt, spec_prompt, validate
from pagequery.sources.fetch import Fetcher
from pagequery.sources.store import Store


class Engine:
    """One run over a store: batches, the pages visited and the addresses offered to the planner."""

    def __init__(self, store: Store, fetcher: Fetcher, model: Model | None = None, settings: Settings = Settings(), log: Callable[[str], None] = lambda s: None, confirm: Callable[[str], bool] | None = None):
        self.store, self.fetcher, self.model, self.settings, self.log, self.confirm = store, fetcher, model, settings, log, confirm
        self.spark = store.spark
        self.batches: dict[str, list[str]] = {}
        self.health: dict[str, str] = {}
        self.offered: set[str] = set()
        self.outlines: list[dict] = []
        self.notes: list[str] = []
        self.clamps: list[str] = []
        self.extractors: Counter = Counter()
        self.specs_made = 0
        #: pages that a reader took for mere ways to others
        self.hubs: set[str] = set()

    # ---- pages

    def get(self, addresses: list[str], label: str, **how) -> DataFrame:
        """Fetch a batch; its pages are noted as visited, up to the cap of the run."""
        room = self.settings.cap_pages_run - len(self.health)
        if len(addresses) > room:
            self.notes.append(f"{len(addresses) - max(room, 0)} pages beyond the cap of the run")
        pages = self.fetcher.fetch(addresses[: max(room, 0)], **how).persist()
        rows = pages.select("url", "health").orderBy("seq").collect()
        self.batches[label] = list(dict.fromkeys([*self.batches.get(label, []), *(r.url for r in rows)]))
        self.health.update({r.url: r.health for r in rows})
        return pages

    def pages_of(self, label: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(i, u) for i, u in enumerate(self.batches.get(label, []))], "seq long, url string")
        return wanted.join(self.store.pages(wanted), "url").filter(F.col("health").isin(*health.EXTRACTABLE))

    def look(self, pages: DataFrame) -> None:
        """Outline one page of each template, offer what it links to, and keep the outlines for the next plan."""
        facts = page_facts(pages.select("seq", "url", "status", "health", "html")).persist()
        first = ln.outline(first_per(facts.withColumn("_t", urls.template_key(F.col("url"))), ["_t"], ["seq"]), self.settings)
        rows = [json.loads(x) for (x,) in first.select(F.to_json(F.struct("*"))).limit(self.settings.outlines_per_plan + 1).collect()]
        if len(rows) > self.settings.outlines_per_plan:
            self.notes.append("further outlines were left out of the plan")
        for r in rows[: self.settings.outlines_per_plan]:
            self.outlines.append(r)
            self.offered.update(s["url"] for g in r.get("groups") or [] for s in g["samples"])
            self.offered.update(s["link"] for s in r.get("singles") or [])
            if r.get("next_page"):
                self.offered.add(r["next_page"])
        self.offered.update(self.health)
        facts.unpersist()

    # ---- steps

    def fetch_group(self, step: Step) -> DataFrame | None:
        """The members of a link group of a batch's pages that weren't visited, up to the cap, following next pages."""
        sources, found, seen = list(self.batches.get(step.source, [])), [], set(self.health)
        hops = self.settings.cap_paginate if step.paginate else 0
        for hop in range(hops + 1):
            wanted = self.spark.createDataFrame([(u,) for u in sources], "url string")
            pages = page_facts(wanted.join(self.store.pages(wanted), "url").filter(F.col("health").isin(*health.EXTRACTABLE)).select("url", "html")).persist()
            rows = ln.expand(ln.link_rows(pages), step.group)
            if not self.settings.allow_external:
                rows = rows.filter(urls.domain(F.col("link")) == urls.domain(F.col("url")))
            fresh = rows.join(self.spark.createDataFrame([(u,) for u in seen] or [("",)], "link string"), "link", "left_anti")
            order = fresh.groupBy("link").agg(F.min(F.struct("url", "pos")).alias("at")).orderBy("at").limit(step.cap - len(found))
            found += [r.link for r in order.collect()]
            seen.update(found)
            after = [r.n for r in pages.select(urls.canonical(F.col("next_href"), F.col("url")).alias("n")).distinct().collect() if r.n and r.n not in self.health] if hop < hops else []
            pages.unpersist()
            if len(found) >= step.cap or not after:
                break
            self.get(after, f"{step.source}+{hop}")
            sources = [u for u in after if self.health.get(u) in health.EXTRACTABLE]
            seen.update(after)
        if self.confirm and not self.confirm(f"fetch {len(found)} pages of {step.group}?"):
            return None
        return self.get(found, step.label) if found else None

    def extract(self, run_id: str, step: Step) -> int:
        """Structured data first, then a spec for each cluster of pages, the reader for single pages."""
        fields = list(step.fields)
        pages = page_facts(self.pages_of(step.source).select("url", "final_url", "domain", "html").withColumn("_html", F.col("html"))).withColumnRenamed("_html", "html").persist()
        saved, left = 0, pages
        if step.mode == "auto":
            linked = ex.linked_data(pages, fields).persist()
            saved += self.save(run_id, linked, "structured_data")
            left = pages.join(linked.select("url"), "url", "left_anti")
            for c in ex.clusters(left).collect():  # one row for each layout, of pages bounded by the run's cap
                mine = left.filter(F.col("url").isin(c.urls))
                saved += self.cluster(run_id, c, mine, fields) if c.pages > 1 else self.read(run_id, mine, fields)
        else:
            saved += self.read(run_id, left, fields)
        pages.unpersist()
        return saved

    def cluster(self, run_id: str, cluster: Any, pages: DataFrame, fields: list[str]) -> int:
        """Apply the cached or a new spec to a layout; once more with feedback if the records look wrong, then page by page."""
        if self.model is None:
            return 0
        key = (pages.select("domain").first().domain, cluster.template, ",".join(sorted(f.lower() for f in fields)))
        known = self.store.specs().filter((F.col("domain") == key[0]) & (F.col("template") == key[1]) & (F.col("fields") == key[2])).first()
        samples = pages.orderBy("url").limit(2).select("url", "html", "islands").collect()
        feedback, spec = "", known.spec if known else None
        for _ in range(2):
            if spec is None:
                digest = json.dumps([x.asDict(True) for s in samples for x in s.islands or []])
                raw = self.model.ask_json(spec_prompt(fields, [prune(s.html, self.settings.synth_html_cap) for s in samples], digest) + feedback, "spec", "synthesize")
                try:
                    made = ex.Spec.read(raw)
                    ex.validate(made, samples[0].html)
                    self.specs_made += 1
                    spec = made.json()
                except ex.SpecError as e:
                    feedback = f"\nThe last spec failed: {e}"
                    continue
            records = ex.extract(pages, spec, base="final_url").persist()
            state = ex.output_health(records, fields).first()
            if state and state.ok:
                row = self.spark.createDataFrame([(*key, spec, True)], "domain string, template string, fields string, spec string, healthy boolean")
                if known is None or known.spec != spec:
                    self.store.save_specs(row)
                return self.save(run_id, records, f"spec:{cluster.template}")
            feedback, spec = f"\nThe last spec gave: {state.problems if state else 'no records'}", None
        self.notes.append(f"{cluster.template}: no sound spec, pages are read one by one")
        return self.read(run_id, pages, fields)

    def read(self, run_id: str, pages: DataFrame, fields: list[str]) -> int:
        """Have the model read pages, each once: a list bounded by the run's caps."""
        if self.model is None:
            return 0
        out = []
        for p in pages.select("url", F.substring("main_text", 1, self.settings.extract_text_cap).alias("text"), F.array_join("jsonld", "\n").alias("sd"), "links").collect():
            found = [f"{x.text}: {x.href}" for x in p.links if x.region not in ("nav", "footer")]
            answer = self.model.ask_json(read_prompt(fields, p.text, p.sd, found), "read", "extract") or {}
            if answer.get("needs_navigation"):
                self.hubs.add(p.url)
            out += [(p.url, i, {f: None if r.get(f) in ("", None) else str(r[f]) for f in fields}) for i, r in enumerate(answer.get("records") or []) if isinstance(r, dict)]
        return self.save(run_id, self.spark.createDataFrame(out, "url string, item_pos int, data map<string,string>"), "model") if out else 0

    def enrich(self, run_id: str, step: Step) -> None:
        """Fetch the pages that records name, and attach what they say."""
        rows = self.store.records(run_id).withColumn("text", F.col("data")).withColumn("data", F.from_json("data", "map<string,string>")).persist()
        wanted = [r.u for r in rows.select(urls.canonical(F.col("data")[step.url_field]).alias("u")).filter("u is not null").distinct().limit(self.settings.cap_per_group).collect()]
        if not wanted or (self.confirm and not self.confirm(f"enrich from {len(wanted)} pages?")):
            return
        pages = page_facts(self.get(wanted, f"enrich{len(self.batches)}").select("url", "html"))
        out = ex.enrich(rows.filter(F.col("data")["_enrichment"].isNull()), pages, step.url_field).filter("enrichment is not null")
        body = F.concat(F.regexp_replace("text", r"\}\s*$", ""), F.lit(', "_enrichment": '), F.to_json("enrichment"), F.lit("}"))
        self.store.update_records(out.select("seq", body.alias("data")))

    def save(self, run_id: str, records: DataFrame, extractor: str) -> int:
        n = self.store.add_records(records.select(F.lit(run_id).alias("run_id"), F.col("url").alias("source_url"), F.lit(extractor).alias("extractor"), F.to_json("data").alias("data")))
        self.extractors[extractor] += n
        return n

    # ---- the loop

    def run(self, objective: str, start: list[str], fields: list[str]) -> dict:
        """The report of a run; its state is done, stuck, max_cycles, budget_exceeded or no_planner."""
        run_id = uuid.uuid4().hex
        self.store.save_run(run_id, objective, start, fields, {"settings": str(self.settings)}, "running")
        reason = ""
        try:
            self.look(self.get(start, "start"))
            self.store.log(run_id, "probe", {"pages": len(self.health)})
            state = self._fast(run_id, fields) or self._cycles(run_id, objective, fields)
        except BudgetExceeded as e:
            state, reason = "budget_exceeded", str(e)
        report = self.report(run_id, state, reason)
        self.store.save_run(run_id, objective, start, fields, {"settings": str(self.settings)}, state, report)
        return report

    def _fast(self, run_id: str, fields: list[str]) -> str | None:
        """A few start pages are read at once: structured data first, then the model. A plan follows if any only leads elsewhere or nothing was found."""
        if len(self.batches["start"]) > self.settings.fast_path_pages or not fields:
            return None
        pages = page_facts(self.pages_of("start").select("url", "final_url", "domain", "html").withColumn("_html", F.col("html"))).withColumnRenamed("_html", "html").persist()
        linked = ex.linked_data(pages, fields).persist()
        left = pages.join(linked.select("url"), "url", "left_anti")
        saved = 0
        if self.model is not None or left.isEmpty():
            saved = self.save(run_id, linked, "structured_data") + self.read(run_id, left, fields)
        pages.unpersist()
        starts = self.hubs & set(self.batches["start"])
        if starts or not saved:
            self.notes.append(f"the start pages weren't enough: {saved} records, {len(starts)} pages lead elsewhere")
            return None
        return "done"

    def _cycles(self, run_id: str, objective: str, fields: list[str]) -> str:
        if self.model is None:
            return "no_planner"
        dry = 0
        for _ in range(self.settings.max_cycles):
            answer = self.model.ask_json(plan_prompt(objective, fields, self.state(run_id), self.outlines, self.settings), "plan", "plan")
            self.outlines = []
            program: Program = validate(answer, set(self.batches), self.offered, fields, self.settings)
            self.clamps += program.clamps
            self.store.log(run_id, "plan", {"steps": [s.kind for s in program.steps], "clamps": program.clamps})
            before = self.store.records(run_id).count()
            for step in program.steps:
                self.log(f"{step.kind} {step.group or step.source}")
                if step.kind == "done":
                    return "done"
                if step.kind == "fetch":
                    mine = step.urls if self.settings.allow_external else [u for u in step.urls if self._own(u)]
                    self.look(self.get(list(mine), step.label))
                elif step.kind == "fetch_group":
                    pages = self.fetch_group(step)
                    if pages is not None:
                        self.look(pages)
                elif step.kind == "extract":
                    self.extract(run_id, step)
                else:
                    self.enrich(run_id, step)
            dry = 0 if self.store.records(run_id).count() > before else dry + 1
            if dry == 2:
                return "stuck"
        return "max_cycles"

    def _own(self, address: str) -> bool:
        """Whether an address is on a host of the start pages."""
        host = lambda u: u.split("/")[2].removeprefix("www.") if u.count("/") > 1 else ""
        return host(address) in {host(u) for u in self.batches.get("start", [])}

    def state(self, run_id: str) -> dict:
        """What a planner is told: counts, a few records, batches by health, what has been clamped."""
        records = self.store.records(run_id)
        return {
            "records": records.count(), "sample": [r.data for r in records.limit(3).collect()], "batches": {b: dict(Counter(self.health.get(u, "?") for u in us)) for b, us in self.batches.items()},
            "fetches": self.fetcher.fetches, "renders": self.fetcher.renders, "clamps": self.clamps[-5:], "notes": self.notes[-5:],
        }

    def report(self, run_id: str, state: str, reason: str = "") -> dict:
        meter = self.model.meter if self.model else None
        return {
            "run_id": run_id, "state": state, "reason": reason, "records": self.store.records(run_id).count(), "by_extractor": dict(self.extractors), "pages_by_health": dict(Counter(self.health.values())),
            "clamps": self.clamps, "notes": [*self.notes, *self.fetcher.summary()], "fetches": self.fetcher.fetches, "renders": self.fetcher.renders, "cache_hits": self.fetcher.cache_hits, "specs_made": self.specs_made,
            "model_calls": meter.calls if meter else 0, "tokens": [meter.tokens_in, meter.tokens_out] if meter else [0, 0], "tokens_by_purpose": meter.by_purpose if meter else {},
        }

