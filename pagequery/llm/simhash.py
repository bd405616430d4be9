"""SimHash near-duplicates through covering locality-sensitive hashing.

Every fingerprint goes into 2^(radius+1) - 1 tables, keyed by the bits that the
table's mask keeps. Bit position i carries the nonzero vector i mod (2^(radius+1)-1) + 1
of radius+1 binary digits, and mask v keeps the positions whose vector has an odd
product with v (Pagh, 2016). Positions at which two fingerprints differ span, if
they are radius or fewer, too few dimensions to meet all products, so some mask
drops every one of them: each pair within the radius shares a key in some table,
with no false negatives. A mask keeps about half the 64 bits.

Equal fingerprints are one node. Rows of a table that share a key come together by
a sort, and a worker links those within the radius into a spanning forest, so that
a group of n yields n - 1 links and not its pairs. A key with more than RUN nodes
is not compared at all there: those nodes spell out their neighbours instead, all
points within half the radius over the bits that the mask dropped. Nodes that share
such a point are within the radius of one another, and each pair within the radius
shares one, so one minimum a point links them, exactly and without any pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.common import materialize, table
from pagequery.llm.components import components

RADIUS, SHINGLE, RUN = 4, 4, 4096
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def text_fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a text's shingles of so many words, repeats included; 0 for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    last = max(1, len(found) - words + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(whole[a:b], 42) for a, b in zip(starts[:last], ends[min(words, len(found)) - 1 :], strict=False)), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the keys as long, fp long): one row for each row of docs (the keys, text); the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(fps, pa.int64())], [*keys, "fp"])

    return docs.select(*[F.col(k).cast("long") for k in keys], "text").mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the fingerprints (uint64) the place of the one that reached it, and whether that is another: a spanning forest of the links."""
    n = len(fps)
    parent = np.full(n, -1, np.int64)
    for i in range(n):
        if parent[i] >= 0:
            continue
        parent[i], front = i, [i]
        while front:
            left = np.flatnonzero(parent < 0)
            if not len(left):
                break
            at = front.pop()
            near = left[np.bitwise_count(fps[left] ^ fps[at]) <= radius]
            parent[near] = at
            front += near.tolist()
    return parent, parent != np.arange(n)


def links(nodes: DataFrame, *, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """(a long, b long): enough links between fingerprints within radius of one another to connect all that links connect.

    nodes has the distinct fingerprints in fp. radius must be even, so that half of
    it is whole.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    kept = masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(kept)])
    placed = nodes.select("fp", F.inline(keys)).repartition("t", "k").sortWithinPartitions("t", "k", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, at, spilt = 0, None, False

        def rows(t, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(t), len(a)).copy(), pa.int32()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["t", "a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            if n > 1 and not spilt:
                fps = np.concatenate(held)
                parent, other = linked_forest(fps.view(np.uint64), radius)
                if other.any():
                    yield rows(-1, fps[other], fps[parent[other]])

        for batch in batches:
            t, k, fp = (np.asarray(batch[c]) for c in ("t", "k", "fp"))
            if not len(t):
                continue
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(t)]])
            first = (int(t[0]), int(k[0]))
            for i in range(len(bounds) - 1):
                a, b = int(bounds[i]), int(bounds[i + 1])
                # runs of one row that begin and end within the batch need no work
                if i and i < len(bounds) - 2 and b - a == 1:
                    if n:
                        yield from close()
                        held, n, at, spilt = [], 0, None, False
                    continue
                mine = first if i == 0 else (int(t[a]), int(k[a]))
                if mine != at:
                    yield from close()
                    held, n, at, spilt = [], 0, mine, False
                held.append(fp[a:b])
                n += b - a
                if n > run or spilt:
                    spilt = True
                    for x in held:
                        yield rows(mine[0], x, x & np.int64(_signed(kept[mine[0]])))
                    held = []
        yield from close()

    found = materialize(placed.mapInArrow(join, "t int, a long, b long"))
    out = found.filter("t < 0").select("a", "b")
    wide = found.filter("t >= 0")
    if wide.isEmpty():
        return out

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = []
        for m in kept:
            free = [_signed(1 << i) for i in range(64) if not m >> i & 1]
            flips.append(np.array([0, *(int(np.bitwise_xor.reduce(np.array(c, np.int64))) for r in range(1, radius // 2 + 1) for c in combinations(free, r))], np.int64))
        for batch in batches:
            ts, fps = np.asarray(batch["t"]), np.asarray(batch["a"])
            for at in range(0, len(ts), 64):
                t, fp = ts[at : at + 64], fps[at : at + 64]
                sizes = [len(flips[i]) for i in t]
                points = np.concatenate([x ^ flips[i] for i, x in zip(t, fp, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t, sizes), pa.int32()), pa.array(points), pa.array(np.repeat(fp, sizes))], ["t", "point", "fp"])

    points = wide.select("t", "a").mapInArrow(near, "t int, point long, fp long")
    least = points.groupBy("t", "point").agg(F.min("fp").alias("b"))
    return out.union(points.join(least, ["t", "point"]).filter("fp != b").select("fp", "b").distinct())


def labelled(fps: DataFrame, first: Column, *, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """(fp, first, component) for each distinct fp of fps: the aggregate first over its rows, and the component by its smallest fingerprint."""
    # a third of all rows may share a fingerprint: they meet as partial minima
    nodes = materialize(fps.groupBy("fp").agg(first.alias("first")))
    found = materialize(components(links(nodes, radius=radius, run=run)))
    # both sides of each join are written tables, so that Spark can split a hot key
    return materialize(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, *, words: int = SHINGLE, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links of radius or fewer differing
    bits reach, itself included. A null text has no words, as an empty one, and
    both have fingerprint 0, linked like any other. Rows that share a doc_id and
    differ in text keep their fingerprints and may lie in different components.
    Rows with a null doc_id have a component of null unless others share it.
    An empty table gives no rows. Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, words=words))
    nodes = labelled(fps, F.min("doc_id"), radius=radius, run=run)
    least = materialize(nodes.groupBy("component").agg(F.min("first").alias("component_id")))
    named = materialize(nodes.join(least, "component").select("fp", "component_id"))
    joined = fps.join(named, "fp", "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, words: int = SHINGLE, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """The rows of docs that come first in their component: one row for each group, with all its columns.

    First is the smallest doc_id, null the last, and of rows that repeat it any
    one. Rows count by themselves: those that share a doc_id, or have none, stay
    each if they lie in different components.
    """
    row = "_row"
    while row in map(str.lower, docs.columns):
        row = "_" + row
    # written with the numbers, which a second reading of docs could deal out otherwise
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    fps = materialize(fingerprints(rows, words=words, keys=("doc_id", row)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))
    found = materialize(labelled(fps, first, radius=radius, run=run).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)))
    # by merging at every size: the rows grow with the input, so no broadcast of them is bounded
    return rows.join(found.hint("merge"), row, "left_semi").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
