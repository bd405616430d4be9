"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone: no ring
table, no state. A generator seeded by the key draws the points at which the
key would jump while shards are appended one by one; the last jump below the
number of shards is the shard. Appending a shard moves just the keys that jump
into it, 1/(n+1) of them.

Slots number the rows of each shard from 0 without gaps. A shard may hold
billions of rows, and one key a third of them, so no task sorts a shard or a key:
rows are written with a number, ranked within (shard, bucket of the number's hash)
and shifted by the number of rows in the shard's earlier buckets. That table of
counts has shards x buckets rows at most, whatever the input, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.llm.common import materialize, spare, table

BUCKETS = 1024


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of key among so many: an int from 0. A null key counts as one key.

    Draw i of a key is XXH64(key, i), of which the upper 31 bits make the
    fraction. From shard b the next jump goes to floor((b + 1) / fraction).
    """
    def step(state: Column, i: Column) -> Column:
        drawn = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        to = F.floor((state["to"] + 1).cast("double") * F.lit(float(1 << 31)) / drawn.cast("double"))
        # once the next jump lies beyond the last shard, the state stays
        return F.when(
            state["to"] < shards,
            F.struct(state["to"].alias("at"), F.least(to, F.lit(shards).cast("bigint")).alias("to")),
        ).otherwise(state)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("to"))
    # each step moves forward by one shard at least, so shards steps are enough
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard(rows: DataFrame, key: str, shards: int, *, buckets: int = BUCKETS) -> DataFrame:
    """rows with shard int, slot long and grown_shard int (the shard if there were one more).

    rows may have any columns; those of these three names are replaced. Rows with
    equal keys share a shard and get different slots. A null key is a key like
    any other. Empty input gives no rows.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    at, bucket, number, start, rank = (spare(rows.columns, c) for c in ("_shard", "_bucket", "_number", "_start", "_rank"))
    # written, as both the counts and the ranks must see the same numbers
    dealt = materialize(rows.select("*", jump_hash(F.col(key), shards).alias(at), F.monotonically_increasing_id().alias(number)))
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(number), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(at).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(at, bucket).agg(F.count(F.lit(1)).alias(start))
    starts = counts.select(at, bucket, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(at, bucket).orderBy(number)))
    return ranked.join(F.broadcast(starts), [at, bucket]).select(
        *names,
        F.col(at).alias("shard"),
        (F.col(start) + F.col(rank) - 1).cast("bigint").alias("slot"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by their doc_id. A null text has size 1 and the crc32 of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard(rows, "doc_id", 8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
