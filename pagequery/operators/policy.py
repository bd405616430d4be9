"""Crawl policy as window functions over a sequence of attempts: caps, budgets, pacing and the render breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.config import Settings


def first_per(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group in an order that has no ties."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_turn") <= n).drop("_turn")


def domain_cap(attempts: DataFrame, cap: int, *, counts: Column | None = None) -> DataFrame:
    """attempts (seq, domain, ...) with capped: whether this one lies beyond cap of its domain's new fetches.

    counts tells which attempts count; cached pages and refused ones don't, and are never capped.
    """
    counts = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    told = running_budget(attempts.withColumn("_counts", counts), F.col("_counts").cast("long"), cap, by="domain")
    return told.withColumn("capped", F.col("_counts") & ~F.col("within")).select(*attempts.columns, "capped")


def running_budget(rows: DataFrame, amount: Column, budget: int, *, by: str | None = None, blocks: int = 1024) -> DataFrame:
    """rows (seq, ...) with spent (up to and with this row) and within, by seq; of each value of by, if that is given.

    The sum over a whole run is made in ranges of seq: a sum within each, and the
    sums of the ranges before it, so that no task sees all rows, or all of one by.
    """
    ends = rows.agg(F.min("seq"), F.max("seq")).first()
    if ends[0] is None:
        return rows.withColumn("spent", F.lit(0).cast("long")).withColumn("within", F.lit(True))
    width = max(1, -(-(ends[1] - ends[0] + 1) // blocks))
    dealt = rows.withColumn("_amount", amount.cast("long")).withColumn("_block", F.floor((F.col("seq") - ends[0]) / width))
    own = [by] if by else []
    sums = dealt.groupBy(*own, "_block").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias("_by") for c in own), F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.sum("_amount").over(Window.partitionBy(*own, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("_block").eqNullSafe(F.col("_at"))
    # without by there is one row for each block, whatever the input; with it as many as there are values, times blocks
    starts, same = (starts, same & F.col(by).eqNullSafe(F.col("_by"))) if by else (F.broadcast(starts), same)
    out = dealt.withColumn("_inside", inside).join(starts, same).withColumn("spent", F.col("_start") + F.col("_inside"))
    return out.withColumn("within", F.col("spent") <= budget).drop("_amount", "_block", "_inside", "_start", "_at", "_by")


def pacing(attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """attempts (seq, domain, arrival double, delay double or null) with start: no sooner than arrival, and delay after the start before it in the domain.

    With d the delay, start(i) = i d + max over j <= i of (arrival(j) - j d), as delays are constant in a domain.
    """
    own = Window.partitionBy("domain").orderBy("seq")
    # the longest delay that a domain asks for holds for all of its attempts
    d = F.greatest(F.lit(float(settings.min_delay)), F.coalesce(F.max("delay").over(Window.partitionBy("domain")), F.lit(0.0)))
    i = F.row_number().over(own) - 1
    placed = attempts.withColumn("_d", d).withColumn("_i", i)
    lead = F.max(F.col("arrival") - F.col("_i") * F.col("_d")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("start", F.col("_i") * F.col("_d") + lead).drop("_d", "_i")


def render_breaker(attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """attempts (seq, domain, soft boolean) with rendered: all before the domain's breaker trips, none after.

    It trips once so many renders have been made of which the given share were
    soft_404. Every attempt here is automatic; with forced ones use
    render_breaker_forced.
    """
    if not settings.render_breaker:
        return attempts.withColumn("rendered", F.lit(True))
    before = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(before)
    soft = F.coalesce(F.sum(F.col("soft").cast("long")).over(before), F.lit(0))
    # a state that trips once stays: what comes later isn't rendered and changes no count
    tripped = (n >= settings.render_breaker_min) & (soft >= settings.render_breaker_ratio * n)
    held = attempts.withColumn("_t", tripped)
    ever = F.max("_t").over(Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.withColumn("rendered", ~ever).drop("_t")


class BreakerState:
    """Counts of one domain; forced renders pass and count, others only while the breaker is closed."""

    def __init__(self, least: int, ratio: float, n: int = 0, soft: int = 0):
        self.least, self.ratio, self.n, self.soft = least, ratio, n, soft

    def attempt(self, soft: bool, forced: bool) -> bool:
        open_ = self.n >= self.least and self.soft >= self.ratio * self.n
        if open_ and not forced:
            return False
        self.n += 1
        self.soft += bool(soft)
        return True


def render_breaker_forced(attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """render_breaker for attempts with forced boolean: forced renders can open the breaker and close it again, so a domain's attempts run in turn."""
    least, ratio, on = settings.render_breaker_min, settings.render_breaker_ratio, settings.render_breaker
    schema = attempts.withColumn("rendered", F.lit(True)).schema

    def run(group: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        state = BreakerState(least, ratio)
        return group.assign(rendered=[state.attempt(s, f) or not on for s, f in zip(group["soft"], group["forced"], strict=True)])

    return attempts.groupBy("domain").applyInPandas(run, schema)


def cap_summary(outcomes: DataFrame) -> DataFrame:
    """(domain, reason, n, message): tallies of attempts not made, by domain and reason (domain_capped, render_skipped, render_broken)."""
    said = F.when(F.col("reason") == "domain_capped", F.lit("%s: %d pages beyond the cap of the domain")).when(F.col("reason") == "render_skipped", F.lit("%s: %d renders beyond the budget")).otherwise(F.lit("%s: %d renders not made, most pages there are gone"))
    counts = outcomes.filter(F.col("reason").isNotNull()).groupBy("domain", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("message", F.replace(F.replace(said, F.lit("%s"), F.col("domain")), F.lit("%d"), F.col("n").cast("string")))


def over_cap(urls_by_domain: DataFrame, cap: int) -> DataFrame:
    """(domain, n): domains of which more addresses are asked for than the cap lets through."""
    return urls_by_domain.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)


def unvisited(members: DataFrame, visited: DataFrame, on: str = "url") -> DataFrame:
    return members.join(visited.select(on), on, "left_anti")


def offered(asked: DataFrame, known: DataFrame, on: str = "url") -> tuple[DataFrame, DataFrame]:
    """(those of asked that are known, the rest)."""
    return asked.join(known.select(on), on, "left_semi"), asked.join(known.select(on), on, "left_anti")


def tokens_by_purpose(calls: DataFrame) -> DataFrame:
    """(purpose, calls, tokens_in, tokens_out) of a log of model calls."""
    return calls.groupBy("purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
