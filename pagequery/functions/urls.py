"""URL algebra as column expressions: canonical form, domains, deny list, group and template keys.

Nothing here needs a Python worker. Spark's own parse_url isn't used, as it refuses
addresses that occur in pages; regular expressions split an address instead.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagequery.functions.exprs import let

# Query keys that only track visitors, a prefix of such keys, and
# domains whose pages can't be fetched without an account.
TRACKING = ("gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "source", "s_kwcid", "yclid", "_hsenc", "_hsmi", "hsa_acc")
TRACKING_PREFIX = "utm_"
DENIED = ("linkedin.com", "crunchbase.com", "pitchbook.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "glassdoor.com")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_REST = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_ID = r"(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{12,})$"


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, _REST + r"([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _REST + r"[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def resolve(url: Column, base: Column | None = None) -> Column:
    """url made absolute against base, before its path is normalised. White space around url goes."""
    url = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    if base is None:
        return url
    origin = F.regexp_extract(base, _REST + r"[^/?#]*", 0)
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(url.rlike(_SCHEME), url)
        .when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(origin, url))
        .when((url == "") | F.startswith(url, F.lit("#")), base)
        .when(F.startswith(url, F.lit("?")), F.concat(bare, url))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), url))
    )


def normal_path(path: Column) -> Column:
    """Dots resolved, repeated slashes joined (but for two in front), no slash at the end; / for nothing."""
    none = F.array().cast("array<string>")

    def add(state: Column, seg: Column) -> Column:
        return F.when(seg.isin("", "."), state).when(seg == "..", F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0)))).otherwise(F.concat(state, F.array(seg)))

    front = F.when(path.rlike("^//(?!/)"), F.lit("//")).otherwise(F.lit("/"))
    return F.concat(front, F.array_join(F.aggregate(F.split(path, "/"), none, add), "/"))


def normal_query(query: Column) -> Column:
    """Tracking keys dropped, pairs sorted by key and value, and encoded alike; empty for none."""

    def read(x: Column) -> Column:
        plus = F.replace(x, F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(x), plus)

    def write(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(read(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), read(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING) & ~F.startswith(p["k"], F.lit(TRACKING_PREFIX))))
    return F.array_join(F.transform(kept, lambda p: F.concat(write(p["k"]), F.lit("="), write(p["v"]))), "&")


def canonical(url: Column, base: Column | None = None) -> Column:
    """The canonical form of an http or https address, else null.

    Scheme and host are lower-cased, default ports, fragments and tracking keys go,
    the path is normalised, the query sorted. A host of nothing or with an unclosed
    bracket gives null.
    """

    def build(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
        host = F.lower(authority_of(u))
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        query = normal_query(query_of(u))
        whole = F.concat(scheme, F.lit("://"), host, normal_path(path_of(u)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
        sound = scheme.isin("http", "https") & (host != "") & (F.contains(host, F.lit("[")) == F.contains(host, F.lit("]")))
        return F.when(sound, whole)

    return let(resolve(url, base), build)


def domain(url: Column) -> Column:
    """The host of an address or of a bare name: lower case, without user, port and one www."""
    host = F.when(url.rlike(_REST), authority_of(url)).otherwise(F.regexp_extract(url, r"^[^/?#]*", 0))
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(host, "^.*@", "")), r":\d*$", ""), r"^www\.", "")


def denied(url: Column, names=DENIED) -> Column:
    """Whether the address is on one of the names or below it."""
    found = domain(url)
    out = F.lit(False)
    for n in names:
        out = out | (found == n) | F.endswith(found, F.lit("." + n))
    return out


def host_key(url: Column) -> Column:
    """The host without one www. and port, or ? for none."""
    host = F.regexp_replace(F.regexp_replace(F.lower(authority_of(url)), r"^www\.", ""), r":\d*$", "")
    return F.when(host == "", F.lit("?")).otherwise(host)


def normal_segment(seg: Column) -> Column:
    """{id} for a UUID or 12 hex digits and more, else runs of digits as {n}."""
    return F.when(seg.rlike(_ID), F.lit("{id}")).otherwise(F.regexp_replace(seg, r"(?U)\d+", "{n}"))


def segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def group_key(url: Column) -> Column:
    """host/folders/* for an address with two segments or more, else null."""
    return let(segments(url), lambda s: F.when(F.size(s) >= 2, F.concat(host_key(url), F.lit("/"), F.array_join(F.transform(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), normal_segment), "/"), F.lit("/*"))))


def template_key(url: Column) -> Column:
    """The group key, or else the host and whole path with its segments normalised."""
    whole = F.concat(host_key(url), F.lit("/"), F.array_join(F.transform(segments(url), normal_segment), "/"))
    return F.coalesce(group_key(url), whole)


def register(spark: SparkSession) -> list[str]:
    """Make these functions known to SQL, as temporary SQL functions over the expressions' own built-ins."""
    made = []
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(url STRING) RETURNS STRING RETURN {body}")
        made.append(name)
    return made


_AUTHORITY_SQL = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
SQL_FUNCTIONS = {
    "page_domain": rf"regexp_replace(regexp_replace(lower(regexp_replace(if(url rlike '^[A-Za-z][A-Za-z0-9+.\\-]*://', {_AUTHORITY_SQL}, regexp_extract(url, '^[^/?#]*', 0)), '^.*@', '')), ':\\d*$', ''), '^www\\.', '')",
    "page_host_key": rf"coalesce(nullif(regexp_replace(regexp_replace(lower({_AUTHORITY_SQL}), '^www\\.', ''), ':\\d*$', ''), ''), '?')",
}
