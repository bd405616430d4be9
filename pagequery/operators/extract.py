"""Specs that turn pages into records: repeating lists, single pages, JSON islands and JSON-LD.

A spec is a small declaration, checked once against a sample page and then applied
to any number of pages in one Arrow pass. Records are maps from field to value, or
JSON text where values keep their types.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.functions import dom, urls
from pagequery.functions.jsonpaths import island_value, linked_data_value, step_into
from pagequery.operators.facts import is_island, structured

# Types of JSON-LD that describe a site rather than its items, and
# the properties in which a field of a common name is looked for, in order.
SITE_TYPES = ("Organization", "WebSite", "WebPage", "BreadcrumbList", "SiteNavigationElement", "SearchAction", "ImageObject", "CollectionPage", "ItemList")
ALIASES = {
    "name": ("name", "headline", "title"),
    "title": ("name", "headline", "title"),
    "description": ("description",),
    "price": ("offers.price", "offers.lowPrice", "price"),
    "currency": ("offers.priceCurrency", "priceCurrency"),
    "availability": ("offers.availability", "availability"),
    "image": ("image",),
    "brand": ("brand.name", "brand"),
    "sku": ("sku",),
    "url": ("url", "@id"),
    "rating": ("aggregateRating.ratingValue",),
    "date": ("datePublished", "startDate"),
    "author": ("author.name", "author"),
}
KINDS = ("list", "detail", "island")


class SpecError(ValueError):
    """A spec that is malformed or doesn't fit its sample page."""


@dataclass(frozen=True)
class Spec:
    kind: str
    #: list and detail: name -> (selector, attribute); island: name -> path
    fields: dict[str, Any] = field(default_factory=dict)
    item_selector: str = ""
    island_selector: str = ""
    path: str = ""

    @classmethod
    def read(cls, raw: dict | str) -> Spec:
        raw = json.loads(raw) if isinstance(raw, str) else raw
        if not isinstance(raw, dict) or raw.get("kind") not in KINDS or not isinstance(raw.get("fields"), dict) or not raw["fields"]:
            raise SpecError("a spec has a kind (list, detail or island) and fields")
        if raw["kind"] == "island":
            found = {k: v if isinstance(v, str) else (v or {}).get("path", "") for k, v in raw["fields"].items()}
        else:
            found = {k: (v.get("sel", ""), v.get("attr", "text")) if isinstance(v, dict) else (str(v), "text") for k, v in raw["fields"].items()}
        return cls(raw["kind"], found, raw.get("item_selector", ""), raw.get("island_selector", ""), raw.get("path", ""))

    def json(self) -> str:
        found = self.fields if self.kind == "island" else {k: {"sel": s, "attr": a} for k, (s, a) in self.fields.items()}
        return json.dumps({"kind": self.kind, "item_selector": self.item_selector, "island_selector": self.island_selector, "path": self.path, "fields": found}, sort_keys=True)


def _dom_value(node: dom.Node, test, attr: str, base: str) -> str | None:
    n = node if test is None else next((x for x in node.walk() if test(x)), None)
    if n is None:
        return None
    if attr == "text":
        value = n.text(" ")
    elif attr == "html":
        value = n.html()
    else:
        value = n.attrs.get(attr, "").strip()
        if value and attr in ("href", "src"):
            value = urljoin(base, value)
    return value or None


def island_items(spec: Spec, root: dom.Node) -> list[dict]:
    """The objects at the spec's path of the first island that parses and has something there."""
    test = dom.compile_selector(spec.island_selector) if spec.island_selector else is_island
    for n in root.walk():
        if not test(n):
            continue
        try:
            found = step_into(json.loads("".join(n.strings())), spec.path)
        except ValueError:
            continue
        if isinstance(found, dict):
            return [found]
        if isinstance(found, list) and any(isinstance(x, dict) for x in found):
            return [x for x in found if isinstance(x, dict)]
    return []


def applier(spec: Spec):
    """(html, base) -> records; selectors are compiled once."""
    if spec.kind == "island":
        return lambda html, base: [r for x in island_items(spec, dom.parse(html)) for r in ({k: island_value(x, p, base) for k, p in spec.fields.items()},) if any(r.values())]
    tests = {k: (dom.compile_selector(s) if s else None, a) for k, (s, a) in spec.fields.items()}
    items = dom.compile_selector(spec.item_selector) if spec.kind == "list" else None

    def run(html: str | None, base: str) -> list[dict]:
        root = dom.parse(html)
        nodes = [root] if items is None else [n for n in root.walk() if items(n)]
        found = ({k: _dom_value(n, t, a, base) for k, (t, a) in tests.items()} for n in nodes)
        return [r for r in found if any(r.values())]

    return run


def validate(spec: Spec, html: str | None) -> None:
    """Raise SpecError unless the spec can be applied to this sample page."""
    try:
        applier(spec)
        root = dom.parse(html)
        if spec.kind == "list" and (not spec.item_selector or not dom.select(root, spec.item_selector)):
            raise SpecError(f"item_selector matches nothing: {spec.item_selector!r}")
    except dom.SelectorError as e:
        raise SpecError(str(e)) from e
    if spec.kind == "island" and not island_items(spec, root):
        raise SpecError(f"no island has objects at {spec.path!r}")


def extract(pages: DataFrame, spec: Spec | dict | str, *, key: str = "url", base: str | None = None, typed: bool = False, spread: int | None = None) -> DataFrame:
    """(key, item_pos, data): the records of every page, data a map<string,string>, or JSON text with sorted keys if typed.

    Addresses are made absolute against the column base (the key by default). A
    page on which the spec finds nothing, or a null html, gives no rows.
    """
    spec = spec if isinstance(spec, Spec) else Spec.read(spec)
    base = base or key
    rows = pages.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(base), F.lit("")).alias("base"), "html")
    rows = rows.repartition(spread) if spread else rows
    kind = pa.string() if typed else pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = applier(spec)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                keys, places, data = [], [], []
                for k, b, h in zip(batch["key"].to_pylist(), batch["base"].to_pylist(), batch["html"].to_pylist(), strict=True):
                    for i, r in enumerate(apply(h, b)):
                        keys.append(k)
                        places.append(i)
                        data.append(json.dumps(r, sort_keys=True, ensure_ascii=False) if typed else [(n, v if v is None or isinstance(v, str) else json.dumps(v)) for n, v in r.items()])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(data, kind)], ["key", "item_pos", "data"])

    out = rows.mapInArrow(run, f"key string, item_pos int, data {'string' if typed else 'map<string,string>'}")
    return out.select(F.col("key").alias(key), "item_pos", "data")


def pivot(records: DataFrame, fields: list[str]) -> DataFrame:
    """data spread out into a column for each field."""
    others = [c for c in records.columns if c != "data"]
    return records.select(*others, *[F.col("data")[f].alias(f) for f in fields])


# ---- JSON-LD


def linked_record(blocks: list[str], fields: list[str]) -> dict[str, str | None] | None:
    """The record of the node that answers most fields, the first of equals; None unless it answers half of them."""
    nodes = []
    for raw in blocks:
        block = json.loads(raw)
        graph = block.get("@graph") if isinstance(block, dict) else None
        nodes += [x for x in [block, *(graph if isinstance(graph, list) else [])] if isinstance(x, dict)]
    best, most = None, 0
    for node in nodes:
        kinds = node.get("@type")
        if set(kinds if isinstance(kinds, list) else [kinds]) & set(SITE_TYPES):
            continue
        record = {f: next((v for p in ALIASES.get(f.lower(), (f,)) if (v := linked_data_value(node, p))), None) for f in fields}
        hits = sum(v is not None for v in record.values())
        if hits > most:
            best, most = record, hits
    return best if best is not None and most >= max(1, math.ceil(len(fields) / 2)) else None


def linked_data(pages: DataFrame, fields: list[str], *, key: str = "url", spread: int | None = None) -> DataFrame:
    """(key, item_pos, data): a record for each page whose JSON-LD answers at least half of the fields."""
    rows = pages.select(F.col(key).cast("string").alias("key"), "html")
    rows = rows.repartition(spread) if spread else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, linked_record(structured(dom.parse(h))[0], fields)) for k, h in zip(batch["key"].to_pylist(), batch["html"].to_pylist(), strict=True)]
            found = [(k, r) for k, r in found if r]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([0] * len(found), pa.int32()), pa.array([list(r.items()) for _, r in found], pa.map_(pa.string(), pa.string()))], ["key", "item_pos", "data"])

    return rows.mapInArrow(run, "key string, item_pos int, data map<string,string>").withColumnRenamed("key", key)


# ---- quality of records and clusters of pages


def output_health(records: DataFrame, fields: list[str], by: list[str] | None = None, expected: Column | None = None) -> DataFrame:
    """A row for each group by: records, ok and problems, from the share of nulls of each field and of distinct values of the first.

    The first field is the key: null in more than half the records, or fewer
    distinct values than half of four or more, is a problem; so is another field
    null in more than four fifths, no record at all, or half as many as expected
    (a column that is constant in each group).
    """
    by = by or []
    value = lambda f: F.col("data")[f]
    measures = [F.count(F.lit(1)).alias("records"), F.count_distinct(value(fields[0])).alias("distinct")]
    measures += [F.count(value(f)).alias(f"n{i}") for i, f in enumerate(fields)]
    measures += [F.max(expected).alias("expected")] if expected is not None else [F.lit(None).cast("long").alias("expected")]
    sums = records.groupBy(*by).agg(*measures)
    missing = lambda i: 1 - F.col(f"n{i}") / F.col("records")
    tests = [
        (F.col("records") == 0, "no records"),
        ((F.col("records") > 0) & (missing(0) > 0.5), f"{fields[0]} is mostly null"),
        ((F.col("n0") >= 4) & (F.col("distinct") < 0.5 * F.col("n0")), f"{fields[0]} repeats"),
        *(((F.col("records") > 0) & (missing(i) > 0.8), f"{f} is null") for i, f in enumerate(fields) if i),
        (F.col("records") < 0.5 * F.col("expected"), "fewer records than expected"),
    ]
    problems = F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda x: x.isNotNull())
    return sums.select(*by, "records", (F.size(problems) == 0).alias("ok"), problems.alias("problems"))


def clusters(pages: DataFrame, key: str = "url") -> DataFrame:
    """(template, dom_shape, pages, urls): pages of one template and layout, the largest first; key is canonical."""
    return pages.groupBy(urls.template_key(F.col(key)).alias("template"), "dom_shape").agg(F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_list(key)).alias("urls")).orderBy(F.desc("pages"), "template", "dom_shape")


def cached_specs(found: DataFrame, specs: DataFrame, domain: str, fields: list[str]) -> DataFrame:
    """clusters with the newest healthy spec for their domain, template and fields, null where there is none."""
    asked = ",".join(sorted(f.lower() for f in fields))
    newest = Window.partitionBy("domain", "template", "fields").orderBy(F.desc("version"))
    mine = specs.filter(F.col("healthy") & (F.col("domain") == domain) & (F.col("fields") == asked)).withColumn("turn", F.row_number().over(newest)).filter("turn = 1")
    return found.join(mine.select("template", "spec", "version"), "template", "left")


def enrich(records: DataFrame, pages: DataFrame, url_field: str = "url") -> DataFrame:
    """records with enrichment (title, description, text_preview, url) of the page that the field names, null for none, denied or unfit addresses; enriched ones stay.

    pages has canonical url, title, meta_description and main_text, once each.
    """
    target = urls.canonical(F.col("data")[url_field])
    asked = records.withColumn("_target", F.when(~urls.denied(target), target))
    known = pages.select(F.col("url").alias("_target"), F.struct("title", F.col("meta_description").alias("description"), F.substring("main_text", 1, 400).alias("text_preview"), F.col("url")).alias("_new"))
    out = asked.join(known, "_target", "left").drop("_target")
    old = F.col("enrichment") if "enrichment" in records.columns else F.lit(None)
    return out.withColumn("enrichment", F.coalesce(old, F.col("_new"))).drop("_new")
