"""Exact top-k search by distributed histogram selection.

Every round scores every candidate against every query of a block, by batched
integer-valued matrix products, and counts the scores of each query in BINS bins
of its present range, in numpy. The counts of a task below the bin in which the
task's own kth score lies can't matter and aren't sent; the rest is summed per
(query, bin) with partial aggregation, and the bin that holds the global kth score
becomes the query's range of the next round, until bins are one wide and the kth
score is known. A last pass keeps the candidates at or above it; a task passes on
k of them for each query at most, the best by (score, vec_id), so that ties of any
number don't gather anywhere.

Queries come in blocks of about BLOCK rows, which bounds what is broadcast and what
the driver holds, whatever the number of queries. Vectors are written once as
integers and read again each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.llm.common import drop_path, materialize, table

K, BLOCK, BINS, CHUNK = 10, 2048, 2048, 512


def integer_vectors(rows: DataFrame, *, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, v array<long>, top): floor(scale * x) of each component; rows with a null vector or a null or non-finite component are left out.

    rid tells rows apart that share an id. top is the largest absolute component.
    """
    x = F.col(vector)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    sound = x.isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(sound).select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("vec_id"), whole.alias("v")).withColumn(
        "top", F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))), F.lit(0.0))
    )


def _scored(batches: Iterator[pa.RecordBatch], block: dict) -> Iterator[tuple]:
    """(places of queries, rids, vec_ids, scores queries x candidates) for each chunk of candidates and each width of vectors.

    Scores are exact: in double precision where sums stay below 2^53, else in 64-bit integers, which wrap.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            v = part["v"]
            sizes = np.diff(np.asarray(v.offsets))
            flat = np.asarray(v.flatten())
            rid, ids = np.asarray(part["rid"]), np.asarray(part["vec_id"])
            starts = np.cumsum(sizes) - sizes
            for n, (places, vectors, kind) in block.items():
                mine = np.flatnonzero(sizes == n)
                if len(mine):
                    c = flat[starts[mine][:, None] + np.arange(n)].astype(kind)
                    yield places, rid[mine], ids[mine], (vectors @ c.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query by score down, then id up."""
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, queries: Column | str, *, k: int = K, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row of vectors for which queries holds.

    vectors is as integer_vectors() returns it. A row is no candidate of itself;
    other rows are, even with an equal id or vector. Ties go to the smaller vec_id,
    then to the earlier row. Vectors of another length than the query's take no
    part. Fewer candidates than k give all of them. No rows give no rows.
    """
    spark = vectors.sparkSession
    paths: list[str] = []
    kept = materialize(vectors, paths)
    asked = kept.filter(queries)
    n = asked.count()
    blocks = max(1, -(-n // block))
    top = kept.agg(F.max("top"), F.max(F.size("v"))).first()
    exact = (top[0] or 0.0) ** 2 * (top[1] or 0) < 2**52
    bound = int(min((top[0] or 0.0) ** 2 * (top[1] or 0), 2**63 - 2)) + 1 if exact else 2**63 - 1
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).select("rid", "vec_id", "v").collect() if n else []
        if not rows:
            continue
        found = materialize(_search_block(spark, kept, sorted(map(tuple, rows)), k, bins, bound, exact))
        out = found if out is None else out.unionByName(found)
    for p in paths:
        if out is not None:
            drop_path(spark, p)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search_block(spark: SparkSession, kept: DataFrame, rows: list, k: int, bins: int, bound: int, exact: bool) -> DataFrame:
    sizes = np.array([len(r[2]) for r in rows])
    block = {int(w): (np.flatnonzero(sizes == w), np.array([rows[i][2] for i in np.flatnonzero(sizes == w)], np.float64 if exact else np.int64).reshape(-1, int(w)) if w else np.zeros((int((sizes == 0).sum()), 0)), np.float64 if exact else np.int64) for w in np.unique(sizes)}
    own = np.array([r[0] for r in rows])
    # kth scores lie in [low, low + bins * width) of each query, and above counts the scores beyond
    width = 1 << max(0, math.ceil(math.log2((2 * bound + 1) / bins)))
    low, above = np.full(len(rows), -bound, np.int64), np.zeros(len(rows), np.int64)
    few = np.zeros(len(rows), bool)
    # scores at low + span or more are in above already, though the bins may reach them
    span = min(bins * width, 2**64 - 1)
    while True:
        shipped = spark.sparkContext.broadcast((block, own, low, above, width, span))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, own, low, above, width, span = shipped.value
            counts = np.zeros((len(own), bins), np.int64)
            for places, rid, _, scores in _scored(batches, block):
                # unsigned, as scores may lie anywhere in 64 bits
                past = scores.view(np.uint64) - low[places].view(np.uint64)[:, None]
                at = past // np.uint64(width)
                valid = (scores >= low[places][:, None]) & (past < np.uint64(span)) & (at < bins) & (rid[None, :] != own[places][:, None])
                q, c = np.nonzero(valid)
                counts += np.bincount(places[q] * bins + at[q, c].astype(np.int64), minlength=counts.size).reshape(counts.shape)
            # counts below the bin at which this task alone reaches k can't decide
            after = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
            q, i = np.nonzero((counts > 0) & (after + above[:, None] < k))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int32()), pa.array(counts[q, i])], ["q", "bin", "n"])

        sums = kept.select("rid", "vec_id", "v").mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        before = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        start = spark.createDataFrame([(i, int(a)) for i, a in enumerate(above)], "q int, above long")
        chosen = (
            sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("turn", F.row_number().over(down))
            .join(F.broadcast(start), "q").withColumn("over", F.col("above") + F.col("before")).filter(F.col("over") < k)
            .groupBy("q").agg(F.min(F.struct("bin", "over", "n")).alias("x")).select("q", "x.*").collect()
        )
        shipped.unpersist()
        seen = np.zeros(len(rows), bool)
        for r in chosen:
            seen[r.q] = True
            low[r.q] = int(low[r.q]) + r.bin * width
            above[r.q] = r.over
            few[r.q] |= r.over + r.n < k
        few |= ~seen
        if width == 1:
            break
        span, width = width, max(1, -(-width // bins))
    # a query with fewer than k candidates keeps them all
    least = np.where(few, -(2**63), low)
    shipped = spark.sparkContext.broadcast((block, own, np.array([r[1] for r in rows]), least))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, names, least = shipped.value
        best: dict[int, tuple] = {}
        for places, rid, ids, scores in _scored(batches, block):
            q, c = np.nonzero((scores >= least[places][:, None]) & (rid[None, :] != own[places][:, None]))
            cuts = np.flatnonzero(np.diff(q)) + 1
            for cs, i in zip(np.split(c, cuts), q[np.concatenate([[0], cuts])] if len(q) else [], strict=False):
                p = int(places[i])
                new = (scores[i, cs], ids[cs], rid[cs])
                old = best.get(p)
                s, d, r = new if old is None else (np.concatenate(x) for x in zip(old, new, strict=True))
                order = np.lexsort((r, d, -s))[:k]
                best[p] = (s[order], d[order], r[order])
        for p, (s, d, r) in best.items():
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own[p])), pa.array(np.full(n, names[p])), pa.array(d), pa.array(s), pa.array(r)], ["own", "query_id", "vec_id", "score", "rid"])

    kind = "own long, query_id long, vec_id long, score long, rid long"
    found = kept.select("rid", "vec_id", "v").mapInArrow(keep, kind)
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best for every vector whose vec_id is divisible by 100."""
    return search(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op6_sql(k: int = K, scale: int = 1024) -> str:
    """The same in DuckDB, for vectors that all have the same length and distinct ids."""
    return f"""WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
