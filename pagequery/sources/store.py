"""A store of pages, runs, records, specs and events: Parquet logs that are only appended to, and views of the newest rows.

A table is a folder of snapshots; a pointer file names the present one, so that
compaction and deletion write anew and then move the pointer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "pages": "url string, final_url string, domain string, status int, method string, health string, html string, content_hash string, fetched_at timestamp",
    "runs": "run_id string, objective string, start_urls array<string>, fields array<string>, config string, state string, report string, started_at timestamp, finished_at timestamp, written_at timestamp",
    "records": "run_id string, source_url string, extractor string, data string, created_at timestamp, seq long",
    "extractors": "domain string, template string, fields string, spec string, version int, healthy boolean, created_at timestamp",
    "events": "run_id string, ts timestamp, kind string, detail string",
}


def content_hash(html: Column) -> Column:
    """The first 16 hex digits of SHA-256; null for null."""
    return F.substring(F.sha2(html, 256), 1, 16)


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The newest row of each key; order puts the newest first."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_turn = 1").drop("_turn")


def fresh(pages: DataFrame, cutoff: Column) -> DataFrame:
    """Pages fetched at the cutoff or after it; those without a time are stale."""
    return pages.filter(F.col("fetched_at") >= cutoff)


def next_versions(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("domain", "template", "fields")) -> DataFrame:
    """new specs with version: one more than the newest old one if the spec differs from it, the same if not, 1 for a first."""
    newest = latest(old, list(keys), F.desc("version")).select(*keys, F.col("spec").alias("_spec"), F.col("version").alias("_version"))
    joined = new.drop("version").join(newest, list(keys), "left")
    return joined.withColumn("version", F.when(F.col("_version").isNull(), 1).when(F.col("_spec") == F.col("spec"), F.col("_version")).otherwise(F.col("_version") + 1).cast("int")).drop("_spec", "_version")


def new_records(found: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("run_id", "source_url", "data")) -> DataFrame:
    """Rows of found that known lacks, once each."""
    return found.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


class Store:
    """Tables under a folder that Spark can write. Nothing is written before the first write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- snapshots

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        return base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _snapshot(self, name: str) -> str | None:
        fs, path = self._fs()
        pointer = path(f"{self.path}/{name}/CURRENT")
        if not fs.exists(pointer):
            return None
        row = self.spark.read.text(f"{self.path}/{name}/CURRENT").first()
        return f"{self.path}/{name}/{row.value}"

    def _point(self, name: str, snapshot: str) -> None:
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/{name}/CURRENT"), True)
        out.write(bytearray(snapshot.encode()))
        out.close()

    def read(self, name: str) -> DataFrame:
        found = self._snapshot(name)
        if found is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(found)

    def append(self, name: str, rows: DataFrame) -> None:
        snapshot = self._snapshot(name)
        if snapshot is None:
            label = uuid.uuid4().hex
            self._shape(name, rows).write.mode("append").parquet(f"{self.path}/{name}/{label}")
            self._point(name, label)
        else:
            self._shape(name, rows).write.mode("append").parquet(snapshot)

    def _shape(self, name: str, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new snapshot of rows; the old one goes once the pointer has moved."""
        old, label = self._snapshot(name), uuid.uuid4().hex
        self._shape(name, rows).write.parquet(f"{self.path}/{name}/{label}")
        self._point(name, label)
        if old:
            fs, path = self._fs()
            fs.delete(path(old), True)

    # ---- pages

    def pages(self, wanted: DataFrame | None = None) -> DataFrame:
        """The newest row of each page, or of those in wanted (url): only their rows, with their html, are ranked then."""
        rows = self.read("pages")
        if wanted is not None:
            rows = rows.join(wanted.select("url").distinct(), "url", "left_semi")
        return latest(rows, ["url"], F.desc_nulls_last("fetched_at"), F.desc("content_hash"))

    def save_pages(self, pages: DataFrame) -> None:
        self.append("pages", pages.withColumn("content_hash", content_hash(F.col("html"))))

    def cached(self, urls: DataFrame, max_age_days: float | None, now: Column | None = None) -> DataFrame:
        """urls (url, ...) with the cached page's columns, null where there is none that is fresh."""
        pages = self.pages(urls)
        if max_age_days is not None:
            pages = fresh(pages, (now if now is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(max_age_days * 86400.0).cast("decimal(18,6)")))
        return urls.join(pages, "url", "left")

    def prune_pages(self, days: float, now: Column | None = None) -> int:
        """Delete pages older than so many days or without a time; returns how many went. Only when asked."""
        pages = self.pages()
        kept = fresh(pages, (now if now is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(days * 86400.0).cast("decimal(18,6)")))
        before, after = pages.count(), kept.count()
        self.replace("pages", kept)
        return before - after

    # ---- records, specs, runs, events

    def add_records(self, records: DataFrame) -> int:
        """Append what is new by (run_id, source_url, data); returns how many rows that was."""
        old = self.read("records")
        start = old.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        fresh_rows = new_records(records, old).withColumn("created_at", F.current_timestamp()).withColumn("seq", F.monotonically_increasing_id() + start)
        before = old.count()
        self.append("records", fresh_rows)
        return self.read("records").count() - before

    def records(self, run_id: str) -> DataFrame:
        return self.read("records").filter(F.col("run_id") == run_id).orderBy("seq")

    def update_records(self, changed: DataFrame) -> None:
        """Replace data of records by (seq, data)."""
        new = changed.select("seq", F.col("data").alias("_data"))
        rows = self.read("records").join(new, "seq", "left").withColumn("data", F.coalesce("_data", "data")).drop("_data")
        self.replace("records", rows)

    def save_specs(self, specs: DataFrame) -> None:
        self.append("extractors", next_versions(specs, self.read("extractors")).withColumn("created_at", F.current_timestamp()))

    def specs(self) -> DataFrame:
        return latest(self.read("extractors").filter("healthy"), ["domain", "template", "fields"], F.desc("version"), F.desc("created_at"))

    def save_run(self, run_id: str, objective: str, start_urls: list[str], fields: list[str], config: dict, state: str, report: dict | None = None) -> None:
        row = [(run_id, objective, start_urls, fields, json.dumps(config), state, json.dumps(report) if report else None)]
        out = self.spark.createDataFrame(row, "run_id string, objective string, start_urls array<string>, fields array<string>, config string, state string, report string")
        now = F.current_timestamp()
        self.append("runs", out.withColumn("started_at", now).withColumn("finished_at", F.when(F.col("report").isNotNull(), now)).withColumn("written_at", now))

    def run(self, run_id: str):
        found = latest(self.read("runs").filter(F.col("run_id") == run_id), ["run_id"], F.desc("written_at")).collect()
        return found[0] if found else None

    def runs(self, most: int = 20) -> DataFrame:
        return latest(self.read("runs"), ["run_id"], F.desc("written_at")).orderBy(F.desc("started_at")).limit(most)

    def log(self, run_id: str, kind: str, detail: dict) -> None:
        self.append("events", self.spark.createDataFrame([(run_id, kind, json.dumps(detail))], "run_id string, kind string, detail string").withColumn("ts", F.current_timestamp()))

    # ---- whole store

    def counts(self) -> dict[str, int]:
        return {name: (self.pages() if name == "pages" else self.read(name)).count() for name in SCHEMAS}

    def pages_by_health(self) -> DataFrame:
        return self.pages().groupBy("health").count().orderBy(F.desc("count"), "health")

    def wipe(self) -> dict[str, int]:
        counts = self.counts()
        fs, path = self._fs()
        for name in SCHEMAS:
            fs.delete(path(f"{self.path}/{name}"), True)
        return counts

    def compact(self) -> None:
        """Rewrite every table into fresh files; pages lose their older versions."""
        for name in SCHEMAS:
            if self._snapshot(name):
                self.replace(name, self.pages() if name == "pages" else self.read(name))


def export(records: DataFrame) -> DataFrame:
    """value: a JSON line for each record with where it comes from."""
    own = F.when(F.col("data").startswith("{"), F.regexp_replace("data", r"^\{\s*|\s*\}$", "")).otherwise(F.lit(""))
    origin = F.regexp_replace(F.to_json(F.struct(F.col("source_url").alias("_source"), F.col("extractor").alias("_extractor"), F.col("run_id").alias("_run"))), r"^\{|\}$", "")
    return records.select(F.concat(F.lit("{"), F.concat_ws(", ", F.nullif(own, F.lit("")), F.nullif(origin, F.lit(""))), F.lit("}")).alias("value"))


def lines(records: DataFrame) -> Iterator[str]:
    """The export line by line, a partition at a time."""
    for r in export(records).toLocalIterator(prefetchPartitions=True):
        yield r.value
