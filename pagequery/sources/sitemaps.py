"""Sitemaps: a frontier of files that grows level by level, each level one DataFrame pass."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOC = r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"


def robots_sitemaps(body: str | None) -> list[str]:
    """Addresses of the Sitemap lines of a robots.txt."""
    return re.findall(r"(?im)^\s*sitemap\s*:\s*(\S+)", body or "")


def locations(files: DataFrame) -> DataFrame:
    """(file, loc, is_file): the loc entries of files (url, html); those of an index are files."""
    locs = F.transform(F.regexp_extract_all("html", F.lit(_LOC), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return files.select(F.col("url").alias("file"), F.explode(locs).alias("loc"), F.contains(F.lower(F.substring("html", 1, 2000)), F.lit("<sitemapindex")).alias("is_file"))


def discover(spark: SparkSession, get: Callable[[list[str]], DataFrame], site: str, max_files: int = 20) -> tuple[DataFrame, list[str], list[str]]:
    """(addresses (url), files read, files left unread) of a site, breadth first.

    get fetches addresses into rows (url, html). robots.txt names the first files,
    or else /sitemap.xml is one.
    """
    origin = re.match(r"[A-Za-z]+://[^/?#]*", site)[0]
    robots = get([origin + "/robots.txt"]).select("html").first()
    frontier = robots_sitemaps(robots.html if robots else None) or [origin + "/sitemap.xml"]
    read: list[str] = []
    out = spark.createDataFrame([], "url string")
    left: list[str] = []
    while frontier:
        now = list(dict.fromkeys(u for u in frontier if u not in read))
        now, left = now[: max_files - len(read)], now[max_files - len(read) :]
        if not now:
            break
        read += now
        found = locations(get(now)).persist()
        out = out.unionByName(found.filter("not is_file").select(F.col("loc").alias("url")))
        # the files of one level, at most a few times max_files of which are ever read
        frontier = [*left, *(r.loc for r in found.filter("is_file").select("loc").distinct().orderBy("loc").toLocalIterator())]
    return out.distinct(), read, left


def matching(addresses: DataFrame, part: str | None) -> DataFrame:
    return addresses.filter(F.contains("url", F.lit(part))) if part else addresses
