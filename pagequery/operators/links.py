"""Links of pages: distinct by canonical address, split into groups, singles and denied ones."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.config import Settings
from pagequery.functions import urls
from pagequery.functions.exprs import let
from pagequery.operators.facts import FACTS, linked_types

# Fixed orders: content before chrome for groups, navigation first for singles.
GROUP_RANK = {"main": 0, "article": 0, "body": 0, "aside": 1, "header": 2, "nav": 2, "footer": 3}
SINGLE_RANK = {"nav": 0, "main": 1, "body": 2, "article": 2, "header": 3, "aside": 4, "footer": 5}


def ranked(region: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, r in ranks.items():
        out = F.when(region == name, r).otherwise(out)
    return out


def link_rows(pages: DataFrame, key: str = "url", base: str = "url") -> DataFrame:
    """(key, base, pos, link, text, region): one row for each distinct canonical link of a page, from its links column.

    key tells pages apart, base is the address against which links are resolved;
    they may be one column. The first place counts; of the texts the first that
    isn't (image). Links that can't be fetched are left out.
    """
    names = list(dict.fromkeys([key, base]))
    each = pages.select(*names, F.explode("links").alias("l")).select(*names, F.col("l.pos").alias("pos"), urls.canonical(F.col("l.href"), F.col(base)).alias("link"), F.col("l.text").alias("text"), F.col("l.region").alias("region"))
    real = F.when(F.col("text") != "(image)", F.struct("pos", "text"))
    return (
        each.filter(F.col("link").isNotNull()).groupBy(key, "link")
        .agg(F.min("pos").alias("first"), F.min(real).alias("real"), F.min_by("region", "pos").alias("region"), *[F.first(n).alias(n) for n in names[1:]])
        .select(*names, F.col("first").alias("pos"), "link", F.coalesce("real.text", F.lit("(image)")).alias("text"), "region")
    )


def denied_counts(links: DataFrame, key: str = "url") -> DataFrame:
    """(key, denied, n): links on denied domains by group key, or by domain for those without one."""
    return links.filter(urls.denied(F.col("link"))).groupBy(key, F.coalesce(urls.group_key(F.col("link")), urls.domain(F.col("link"))).alias("denied")).agg(F.count(F.lit(1)).alias("n"))


def _grouped(links: DataFrame, key: str, least: int) -> DataFrame:
    """Allowed links with gk and members (of a page's group)."""
    allowed = links.filter(~urls.denied(F.col("link"))).withColumn("gk", urls.group_key(F.col("link")))
    return allowed.withColumn("members", F.when(F.col("gk").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(key, "gk"))).otherwise(0)).withColumn("grouped", F.col("members") >= least)


def link_groups(links: DataFrame, settings: Settings = Settings(), key: str = "url", base: str = "url") -> DataFrame:
    """(key, id, place, region, count, external, samples): groups of a page's links, its own content first, other hosts' groups last.

    region is the commonest of the group, the first seen of equal ones.
    """
    mine = _grouped(links, key, settings.group_min).filter("grouped")
    # votes and samples of a group come out of one pass over its links: a link's vote is its region's count in the group
    votes = Window.partitionBy(key, "gk", "region")
    turn = Window.partitionBy(key, "gk").orderBy("pos")
    told = mine.withColumn("n", F.count(F.lit(1)).over(votes)).withColumn("seen", F.min("pos").over(votes)).withColumn("turn", F.row_number().over(turn))
    sample = F.when(F.col("turn") <= settings.samples_per_group, F.struct("pos", "text", "link"))
    out = told.groupBy(key, "gk").agg(
        F.max_by("region", F.struct("n", -F.col("seen"))).alias("region"), F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"), F.first(F.col(base)).alias("at"),
        F.transform(F.array_sort(F.collect_list(sample)), lambda s: F.struct(s["text"].alias("text"), s["link"].alias("url"))).alias("samples"),
    ).withColumn("external", F.substring_index("gk", "/", 1) != urls.host_key(F.col("at")))
    order = Window.partitionBy(key).orderBy("external", ranked(F.col("region"), GROUP_RANK, 1), F.desc("count"), "first")
    return out.select(key, F.col("gk").alias("id"), F.row_number().over(order).alias("place"), "region", "count", "external", "samples")


def single_links(links: DataFrame, settings: Settings = Settings(), key: str = "url") -> DataFrame:
    """(key, place, link, text, region, shown): links in no group, navigation first; the first singles_cap are shown."""
    order = Window.partitionBy(key).orderBy(ranked(F.col("region"), SINGLE_RANK, 3), "pos")
    rows = _grouped(links, key, settings.group_min).filter("not grouped").withColumn("place", F.row_number().over(order))
    return rows.select(key, "place", "link", "text", "region", (F.col("place") <= settings.singles_cap).alias("shown"))


def omitted_counts(singles: DataFrame, key: str = "url") -> DataFrame:
    """(key, omitted, by_region): what is left out of the singles shown."""
    each = singles.filter("not shown").groupBy(key, "region").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("omitted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "n")))).alias("by_region"))


def expand(links: DataFrame, group: str, key: str = "url") -> DataFrame:
    """The links of a group; * stands for all that aren't denied."""
    kept = links.filter(~urls.denied(F.col("link")))
    return kept if group == "*" else kept.filter(urls.group_key(F.col("link")) == group)


def repeats(pages: DataFrame, groups: DataFrame, key: str = "url", top: int = 3, base: str = "url") -> DataFrame:
    """(key, place, selector, count, avg_text_chars, sample_text, contains): the top repeated blocks of a page, by count times mean length of text.

    contains is the commonest of the listed groups with three links or more inside.
    """
    names = list(dict.fromkeys([key, base]))
    each = pages.select(*names, F.posexplode("blocks").alias("at", "b")).select(*names, "at", "b.*")
    order = Window.partitionBy(key).orderBy(F.desc(F.col("count").cast("long") * F.greatest("avg_text_chars", F.lit(1))), "at")
    best = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    inside = best.select(*names, "place", F.posexplode("hrefs").alias("i", "href")).withColumn("id", urls.group_key(urls.canonical(F.col("href"), F.col(base)))).filter("id is not null")
    counts = inside.groupBy(key, "place", "id").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).filter("n >= 3")
    vote = counts.join(groups.select(key, "id"), [key, "id"], "left_semi").groupBy(key, "place").agg(F.max_by("id", F.struct("n", -F.col("first"))).alias("contains"))
    return best.join(vote, [key, "place"], "left").select(key, "place", "selector", "count", "avg_text_chars", "sample_text", "contains")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, as in local tests, a new folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pagequery-")
    return found.rstrip("/")


def computed_once(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that branches built on it read the written rows."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def link_parts(pages: DataFrame, settings: Settings = Settings(), key: str = "url", base: str = "url") -> DataFrame:
    """(key, links_total, groups, singles, omitted, by_region, denied): what link_groups(), single_links(), omitted_counts() and denied_counts() tell, a row for each page with links.

    Pages are dealt out by key once; every grouping and window after that is within
    a page and shuffles nothing.
    """
    dealt = pages.select(*dict.fromkeys([key, base]), "links").repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    gk, link = F.col("gk"), F.col("link")
    rows = link_rows(dealt, key, base).withColumn("gk", urls.group_key(link)).withColumn("bad", urls.denied(link))
    group = Window.partitionBy(key, "bad", "gk")
    rows = rows.withColumn("grouped", ~F.col("bad") & gk.isNotNull() & (F.count(F.lit(1)).over(group) >= settings.group_min))
    rows = rows.withColumn("votes", F.count(F.lit(1)).over(group.partitionBy(key, "bad", "gk", "region"))).withColumn("seen", F.min("pos").over(group.partitionBy(key, "bad", "gk", "region"))).withColumn("turn", F.row_number().over(group.orderBy("pos")))
    name = F.when(F.col("bad"), F.coalesce(gk, urls.domain(link))).when(F.col("grouped"), gk)
    each = rows.withColumn("id", name).groupBy(key, "bad", "id").agg(
        F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"), F.first(base).alias("at"), F.max_by("region", F.struct("votes", -F.col("seen"))).alias("region"),
        F.array_sort(F.collect_list(F.when(F.col("grouped") & (F.col("turn") <= settings.samples_per_group), F.struct("pos", "text", "link")))).alias("samples"),
        F.array_sort(F.collect_list(F.when(~F.col("bad") & ~F.col("grouped"), F.struct(ranked(F.col("region"), SINGLE_RANK, 3).alias("rank"), "pos", "link", "text", "region")))).alias("alone"),
    )
    external = F.substring_index("id", "/", 1) != urls.host_key(F.col("at"))
    samples = F.transform("samples", lambda s: F.struct(s["text"].alias("text"), s["link"].alias("url")))
    found = F.struct(external.alias("external"), ranked(F.col("region"), GROUP_RANK, 1).alias("rank"), (-F.col("count")).alias("less"), "first", "id", "region", "count", samples.alias("samples"))
    listed = each.groupBy(key).agg(
        F.sum("count").alias("links_total"), F.array_sort(F.collect_list(F.when(~F.col("bad") & F.col("id").isNotNull(), found))).alias("g"),
        F.array_sort(F.flatten(F.collect_list("alone"))).alias("s"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.struct(F.col("id").alias("denied"), F.col("count").alias("n"))))).alias("d"),
    )
    groups = F.transform("g", lambda x, i: F.struct((i + 1).alias("place"), x["id"].alias("id"), x["region"].alias("region"), x["count"].alias("count"), x["external"].alias("external"), x["samples"].alias("samples")))
    singles = F.transform(F.slice("s", 1, settings.singles_cap), lambda x, i: F.struct((i + 1).alias("place"), x["link"].alias("link"), x["text"].alias("text"), x["region"].alias("region")))
    rest = F.transform(F.slice("s", F.lit(settings.singles_cap + 1), F.size("s")), lambda x: x["region"])
    by_region = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("rest")), lambda r: F.struct(r.alias("region"), F.size(F.filter("rest", lambda x: x == r)).cast("long").alias("n"))))
    some = lambda name: F.when(F.size(name) > 0, F.col(name))
    return listed.select(key, "links_total", groups.alias("groups"), singles.alias("singles"), rest.alias("rest"), "d").select(
        key, "links_total", some("groups").alias("groups"), some("singles").alias("singles"), F.size("rest").cast("long").alias("omitted"), F.when(F.size("rest") > 0, by_region).alias("by_region"), F.when(F.size("d") > 0, F.map_from_entries("d")).alias("denied"),
    )


def repeated(blocks: Column, groups: Column, base: Column, top: int = 3) -> Column:
    """The blocks of one page as repeats() tells them, next to its groups: array<struct<place, selector, count, avg_text_chars, sample_text, contains>>."""
    order = F.transform(blocks, lambda b, i: F.struct((-b["count"].cast("long") * F.greatest(b["avg_text_chars"], F.lit(1))).alias("less"), i.alias("at"), b.alias("b")))
    best = F.transform(F.slice(F.array_sort(order), 1, top), lambda x: x["b"])

    def contains(b: Column) -> Column:
        keys = F.transform(b["hrefs"], lambda h: urls.group_key(urls.canonical(h, base)))
        votes = lambda ks: F.transform(groups, lambda g: F.struct(F.size(F.filter(ks, lambda k: k == g["id"])).alias("n"), (-F.array_position(ks, g["id"])).alias("early"), g["id"].alias("id")))
        return let(keys, lambda ks: F.array_max(F.filter(votes(ks), lambda v: v["n"] >= 3))["id"])

    return F.transform(best, lambda b, i: F.struct((i + 1).alias("place"), b["selector"].alias("selector"), b["count"].alias("count"), b["avg_text_chars"].alias("avg_text_chars"), b["sample_text"].alias("sample_text"), contains(b).alias("contains")))


def outline(pages: DataFrame, settings: Settings = Settings(), key: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide row for each page of page_facts() with status and health: what a reader needs to decide about it.

    key is the column of addresses, keep names further columns to carry along. The
    facts are written once with a row number, as two branches read them: links fold
    into a row for each page, which meets the rest of the facts by that number, so
    that rows that share an address stay apart.
    """
    row = "_row"
    rows = computed_once(pages.select(*dict.fromkeys([key, *keep]), "status", "health", *FACTS).withColumn(row, F.monotonically_increasing_id()))
    out = rows.join(link_parts(rows, settings, row, key), row, "left")
    return out.select(
        key, *keep, "status", "health", "title", "meta_description", "headings", linked_types().alias("structured_data_types"),
        F.substring(F.array_join("jsonld", "\n"), 1, 2000).alias("structured_data"), "microdata", F.col("islands").alias("data_islands"), "og",
        F.char_length("main_text").alias("text_chars"), F.substring("main_text", 1, 400).alias("text_preview"), urls.canonical(F.col("next_href"), F.col(key)).alias("next_page"),
        "links_total", "groups", "singles", "omitted", "by_region", "denied", F.when(F.size("blocks") > 0, repeated(F.col("blocks"), F.col("groups"), F.col(key))).alias("repeats"),
    ).fillna({"links_total": 0, "omitted": 0})


def site_patterns(found: DataFrame, url: str = "url", top: int = 40) -> DataFrame:
    """(pattern, n): the commonest group keys among addresses, or the address itself where there is none."""
    return found.groupBy(F.coalesce(urls.group_key(F.col(url)), F.col(url)).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(top)
