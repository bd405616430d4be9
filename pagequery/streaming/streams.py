"""Streaming forms of batch operators: records as pages arrive, breaker and caps as state, fresh pages only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagequery.config import Settings
from pagequery.operators.extract import Spec, extract
from pagequery.operators.policy import BreakerState
from pagequery.sources.store import Store

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, schema: str = PAGES, files_per_trigger: int = 8) -> DataFrame:
    """Pages from Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def record_stream(pages: DataFrame, spec: Spec | dict, **how) -> DataFrame:
    """extract() over a stream: a record leaves as soon as its page is read."""
    return extract(pages, spec, **how)


def into_store(records: DataFrame, store: Store, run_id: str, extractor: str, checkpoint: str):
    """A query that appends records to a store, new ones only, so that a batch that runs again adds nothing."""

    def save(batch: DataFrame, _: int) -> None:
        store.add_records(batch.select(F.lit(run_id).alias("run_id"), F.col("url").alias("source_url"), F.lit(extractor).alias("extractor"), F.to_json("data").alias("data")))

    return records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker_stream(attempts: DataFrame, settings: Settings = Settings(), domain_type: str = "string") -> DataFrame:
    """render_breaker over a stream of attempts (domain, seq, soft, forced): state of two counts for each domain.

    Attempts of a micro-batch run by seq; across batches they run as they come.
    """
    least, ratio = settings.render_breaker_min, settings.render_breaker_ratio

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, soft = state.get if state.exists else (0, 0)
        breaker = BreakerState(least, ratio, n, soft)
        rows = pd.concat(list(groups)).sort_values("seq")
        rows["rendered"] = [breaker.attempt(s, f) for s, f in zip(rows["soft"], rows["forced"], strict=True)]
        state.update((breaker.n, breaker.soft))
        yield rows[["domain", "seq", "soft", "forced", "rendered"]]

    return attempts.groupBy("domain").applyInPandasWithState(run, f"domain {domain_type}, seq long, soft boolean, forced boolean, rendered boolean", "n long, soft long", "append", GroupStateTimeout.NoTimeout)


def cap_stream(attempts: DataFrame, cap: int, domain_type: str = "string") -> DataFrame:
    """domain_cap over a stream of attempts (domain, seq): the count of a domain's fetches is its state."""

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(groups)).sort_values("seq")
        rows["capped"] = [n + i >= cap for i in range(len(rows))]
        state.update((min(n + len(rows), cap),))
        yield rows[["domain", "seq", "capped"]]

    return attempts.groupBy("domain").applyInPandasWithState(run, f"domain {domain_type}, seq long, capped boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def distinct_pages(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """The first of the rows of one url (url, fetched_at timestamp) within so long: state goes when the watermark passes."""
    return pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"])


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that a stream gives now, written as Parquet below a folder that driver and executors share, next to the stream's state."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
