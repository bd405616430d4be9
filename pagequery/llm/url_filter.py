"""URL filters: rules, and trust and distrust spread over the links between hosts.

A url that a rule fits takes the rule's verdict. For the rest the host decides:
trust flows from the hosts of allowed urls along the links (personalised
PageRank), distrust flows from the hosts of blocked urls against the links, as a
page that links to a blocked host is suspect itself. A host is blocked if its
distrust exceeds threshold times its trust; a host that neither reaches is allowed.

Both flows run as one sparse relational fixpoint: arcs (kind, source, target,
share) meet the scores (kind, host, score) in a join, and a sum by (kind, host)
with partial aggregation gives the next scores. Links are counted per pair of
hosts before anything else, so a page or host with very many links costs one row
for each pair. Each round is written to the shared folder, which cuts the lineage.
Scores start at what the seeds give and only grow, so a round's summed change is the
difference of two sums; rounds end when no new host is reached and that change is
within TOLERANCE of the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.common import ascii_lower, drop_path, materialize, table

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
LINK = r"""(?i)\bhref[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:https?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""
TOLERANCE, MOST_ROUNDS, DAMPING, THRESHOLD = 1e-4, 500, 0.85, 1.0
#: Rounds of the SQL, after which 0.85^60 = 0.006 % of the mass at most is still to spread.
SQL_ROUNDS = 60


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null. Of rules of one length the first given wins."""
    found = F.lit(None).cast("string")
    for rule, _ in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    """allow, block, or null for no rule."""
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): the links from pages of one host to another host. Links within a host are left out."""
    targets = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    found = pages.filter(F.contains(F.col("html"), F.lit("//"))).select(host_of(F.col("url")).alias("source"), F.explode(targets).alias("target"))
    return found.withColumn("target", ascii_lower(F.col("target"))).filter("source != '' and target != '' and source != target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def arcs_of(links: DataFrame) -> DataFrame:
    """(kind, source, target, share): trust runs along links, distrust against them; the shares of a source sum to 1."""
    both = links.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n")
    )
    totals = both.groupBy("kind", "source").agg(F.sum("n").alias("total"))
    return both.join(totals, ["kind", "source"]).select("kind", "source", "target", (F.col("n") / F.col("total")).alias("share"))


def propagate(arcs: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(kind, host, score) at the fixpoint, from seeds of the same columns. Hosts that nothing reaches have no row.

    arcs and seeds are read in every round. A graph that hasn't settled after
    most_rounds, which a chain of as many hosts would need, raises an error.
    """
    spark = seeds.sparkSession
    jump = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    if arcs.isEmpty():
        return jump
    state = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()
    scores, paths, before = jump, [], state(jump)
    for _ in range(most_rounds):
        flow = arcs.join(scores.withColumnRenamed("host", "source"), ["kind", "source"]).select("kind", F.col("target").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
        scores = materialize(flow.unionByName(jump).groupBy("kind", "host").agg(F.sum("score").alias("score")), paths)
        for path in paths[:-1]:
            drop_path(spark, path)
        del paths[:-1]
        now = state(scores)
        if now[0] == before[0] and now[1] - before[1] <= tolerance * now[1]:
            return scores
        before = now
    raise RuntimeError(f"scores haven't settled after {most_rounds} rounds")


def blocked_hosts(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Hosts whose distrust exceeds threshold times their trust."""
    sums = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    return sums.filter(F.col("distrust") > F.col("trust") * threshold)


def judge(pages: DataFrame, rules=RULES, *, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    A null url, or one without ://, has an empty host and path, no rule, and is
    allowed. A null html has no links. Repeated rows are judged each. Other
    columns of pages are ignored. An empty table gives no rows.
    """
    url = F.col("url")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    ruled = verdict_of(F.col("rule"), rules)
    # a host's seed is the share of its pages that a rule allows or blocks
    shares = read.filter("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ruled == "allow").alias("trust"), F.count_if(ruled == "block").alias("distrust")
    )
    seeds = materialize(
        shares.selectExpr("host", "stack(2, 'trust', trust / n, 'distrust', distrust / n) as (kind, score)").filter("score > 0").select("kind", "host", "score")
    )
    scores = propagate(materialize(arcs_of(host_links(pages))), seeds, damping=damping, tolerance=tolerance)
    blocked = materialize(blocked_hosts(scores, threshold).select("host", F.lit("block").alias("by_host")))
    return read.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(ruled, F.col("by_host"), F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page, by the rules and else by what has spread to its host."""
    return judge(table(spark, sf_dir, "pages"))


def op1_sql(rules=RULES, rounds: int = SQL_ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, the rounds unrolled."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cases, verdicts = [], []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        cases.append(f"WHEN (host = {q(name)} OR ends_with(host, {q('.' + name)})) AND starts_with(path, {q(slash + rest)}) THEN {q(rule)}")
        verdicts.append(f"WHEN {q(rule)} THEN {q(verdict)}")
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = low("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")
    steps = "".join(
        f""", s{i + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT a.kind, a.target AS host, a.share * s.score * {damping} AS score FROM arcs a JOIN s{i} s ON a.kind = s.kind AND a.source = s.host
  UNION ALL SELECT kind, host, score FROM s0) GROUP BY ALL)"""
        for i in range(rounds)
    )
    return f"""WITH parts AS (SELECT page_id, {host} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
ruled AS (SELECT page_id, host, path, html, CASE {" ".join(cases)} END AS rule FROM parts),
judged AS (SELECT page_id, host, path, html, rule, CASE rule {" ".join(verdicts)} END AS verdict FROM ruled),
shares AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS t, count(*) FILTER (verdict = 'block') AS d FROM judged WHERE host <> '' GROUP BY host),
s0 AS MATERIALIZED (SELECT 'trust' AS kind, host, {1 - damping} * t / n AS score FROM shares WHERE t > 0 UNION ALL SELECT 'distrust', host, {1 - damping} * d / n FROM shares WHERE d > 0),
found AS (SELECT host AS source, {low("unnest(list_distinct(regexp_extract_all(html, " + q(LINK) + ", 1)))")} AS target FROM judged),
links AS (SELECT source, target, count(*) AS n FROM found WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, source, target, n FROM links UNION ALL SELECT 'distrust', target, source, n FROM links),
arcs AS MATERIALIZED (SELECT kind, source, target, n / sum(n) OVER (PARTITION BY kind, source) AS share FROM both_ways){steps},
blocked AS (SELECT host FROM s{rounds} GROUP BY host
  HAVING sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) > {threshold} * sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END))
SELECT page_id, judged.host, path, rule, coalesce(verdict, CASE WHEN blocked.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN blocked ON judged.host = blocked.host"""
