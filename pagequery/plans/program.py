"""The plan language: typed steps, and validation that clamps what a planner asks for."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pagequery.config import Settings

KINDS = ("fetch", "fetch_group", "extract", "enrich", "done")


@dataclass(frozen=True)
class Step:
    kind: str
    #: the batch that a fetch step makes
    label: str = ""
    #: the batch that a step reads
    source: str = ""
    urls: tuple[str, ...] = ()
    group: str = ""
    cap: int = 0
    paginate: bool = False
    fields: tuple[str, ...] = ()
    mode: str = "auto"
    url_field: str = "url"
    reason: str = ""


@dataclass
class Program:
    steps: list[Step] = field(default_factory=list)
    clamps: list[str] = field(default_factory=list)


def _whole(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def validate(plan: Any, batches: set[str], offered: set[str], fields: list[str], settings: Settings = Settings()) -> Program:
    """The steps of a plan that may run, and a note for all that was lowered or dropped.

    from names the batch that a step reads: start where it is missing; prev stands for
    the batch of the latest fetch step of the plan. done ends it.
    """
    out, latest = Program(), ""
    steps = plan.get("steps") if isinstance(plan, dict) else None
    for n, raw in enumerate(steps if isinstance(steps, list) else []):
        if n >= settings.max_steps_per_plan:
            out.clamps.append(f"only the first {settings.max_steps_per_plan} steps count")
            break
        kind = raw.get("do") or raw.get("step") or raw.get("kind") if isinstance(raw, dict) else None
        if kind not in KINDS:
            out.clamps.append(f"dropped: {str(raw)[:120]}")
            continue
        source = raw.get("from") or "start"
        source = latest if source == "prev" and latest else source
        known = source in batches or source in {s.label for s in out.steps if s.label}
        named = [str(f) for f in raw.get("fields") or fields]
        if kind == "done":
            out.steps.append(Step("done", reason=str(raw.get("reason", ""))[:300]))
            break
        if kind == "fetch":
            asked = [u for u in raw.get("urls") or [] if isinstance(u, str)]
            unknown = [u for u in asked if u not in offered]
            if unknown:
                out.clamps.append(f"{len(unknown)} addresses were never offered: {', '.join(unknown)[:120]}")
            kept = [u for u in asked if u in offered][: settings.cap_per_group]
            if kept:
                latest = f"s{n}"
                out.steps.append(Step("fetch", label=latest, urls=tuple(kept)))
        elif kind == "enrich":
            if not settings.allow_external:
                out.clamps.append("enrich needs external pages, which aren't allowed")
            elif not known:
                out.clamps.append(f"unknown source: {source}")
            else:
                out.steps.append(Step("enrich", source=source, url_field=str(raw.get("url_field") or "url")))
        elif not known:
            out.clamps.append(f"unknown source: {source}")
        elif kind == "fetch_group":
            asked = _whole(raw.get("cap"), settings.cap_per_group)
            cap = max(1, min(asked, settings.cap_per_group))
            if cap < asked:
                out.clamps.append(f"cap lowered from {asked} to {cap}")
            latest = f"s{n}"
            out.steps.append(Step("fetch_group", label=latest, source=source, group=str(raw.get("group", "*")), cap=cap, paginate=bool(raw.get("paginate"))))
        else:
            mode = raw.get("mode") if raw.get("mode") in ("auto", "llm") else "auto"
            out.steps.append(Step("extract", source=source, fields=tuple(named), mode=mode))
    return out


#: What a planner must know of the language: every key that validate() reads.
PLAN_RULES = """You decide which pages a crawl fetches and when records are read from them; code does both.
Answer with JSON alone: {"steps": [...]}, at most %d steps, each an object with the key "do":
{"do": "fetch", "urls": [addresses]}: fetch these pages. Only addresses that the outlines below show, or pages fetched before, are let through.
{"do": "fetch_group", "from": batch, "group": id of a link group, "cap": number, "paginate": true or false}: fetch the pages that a batch's pages link to in this group (* for all links); with paginate, of their next pages too.
{"do": "extract", "from": batch, "fields": [names], "mode": "auto" or "llm"}: read records from a batch's pages. auto uses structured data, then one spec for each layout; llm reads page by page.
{"do": "enrich", "from": batch, "url_field": name}: fetch the page that this field of each record names, and attach its title and description.
{"do": "done", "reason": text}: nothing more is needed, or can be had.
"from" is "start" (as when it is left out), the label of a batch in the state, or "prev" for the batch of the step before.
Denied links are never fetched; external groups only where that is allowed. A page whose health is data_shell holds its data in scripts and can be read like others."""

SPEC_RULES = """Answer with JSON alone: a spec with the key "kind" and the key "fields".
"list": "item_selector" is the CSS selector of the repeating element, and "fields" maps each name to {"sel": CSS selector inside the element, "attr": "text", "html" or an attribute such as "href"}.
"detail": one record a page; "fields" as for a list, selectors count from the page.
"island": "island_selector" is the selector of a data script, "path" the dotted path to its objects (digits index a list), and "fields" maps each name to a dotted path inside an object."""

READ_RULES = """Answer with JSON alone: {"records": [one object for each record, with the fields as keys, null for what isn't there], "needs_navigation": true if this page only leads to the pages that hold the records}."""


def plan_prompt(objective: str, fields: list[str], state: dict, outlines: list[dict], settings: Settings = Settings()) -> str:
    return f"{PLAN_RULES % settings.max_steps_per_plan}\nObjective: {objective}\nFields: {', '.join(fields)}\nState: {state}\nPages:\n" + "\n".join(map(str, outlines))


def spec_prompt(fields: list[str], samples: list[str], islands: str) -> str:
    return f"Write an extraction spec for the fields {', '.join(fields)}. All pages of this layout will be read with it.\n{SPEC_RULES}\nData scripts: {islands[:4000]}\n" + "\n---\n".join(samples[:2])


def read_prompt(fields: list[str], text: str, structured: str, links: list[str]) -> str:
    return f"Read the fields {', '.join(fields)} from this page.\n{READ_RULES}\n{text}\n{structured[:2000]}\n" + "\n".join(links[:120])
