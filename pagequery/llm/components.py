"""Connected components of a graph given as edges: contracted within tasks, then by large-star and small-star rounds.

First every task joins the edges that it reads by union-find, CHUNK of them at a
time, and passes on a star for each piece that it finds: fewer edges, of short ways.
Where one chunk holds all edges, those stars are the components.

Otherwise rounds follow. Each round links every node's larger neighbours to its smallest one, then its
smaller ones to the smallest (Kiveris et al., 2014). The number of edges never
grows, the rounds are about logarithmic in the number of nodes, and no node's
neighbours are ever gathered in one place: the smallest neighbour is a partial
aggregate, and it comes back to the edges by a join whose hot keys Spark can split,
as both its sides are read from written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequery.llm.common import drop_path, materialize

#: Edges that a task joins at once: its memory is bounded by them.
CHUNK = 250_000


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the roots to the smallest node that edges (a, b) connect it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # the smaller root of an edge's two ends becomes the other's, and ways to roots are halved
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        if (root[x] == root[y]).all():
            break
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """edges (a, b) as stars within each chunk that a task reads; the components are the same."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def stars() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = local_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append((np.asarray(batch["a"]), np.asarray(batch["b"])))
            n += batch.num_rows
            if n >= chunk:
                yield from stars()
                n = 0
        yield from stars()

    return edges.mapInArrow(join, "a long, b long")


def _star(edges: DataFrame, keep: list[str], large: bool) -> DataFrame:
    """edges (a, b) with a > b; the same after one half of a round."""
    around = edges.select("a", "b").union(edges.select("b", "a")) if large else edges
    least = materialize(around.groupBy("a").agg(F.min("b").alias("m")), keep)
    if large:
        # each larger neighbour b of a meets the least of a's neighbours and a itself
        moved = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        moved = edges.join(least, "a").select("b", "m").filter("b != m").union(least.select("a", "m")).toDF("a", "b")
    return moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it reaches.

    Nodes are longs. Loops and repeated edges change nothing; rows with a null are
    left out. No edges give no rows.
    """
    paths: list[str] = []
    given = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b"), paths)
    n = given.count()
    # neighbouring files are read together, without a shuffle, so that a task fills its chunks
    whole = given.coalesce(max(1, -(-n // chunk)))
    now = materialize(contracted(whole, chunk), paths)
    drop_path(edges.sparkSession, paths.pop(0))
    if n > chunk:
        now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), paths)
        now = _rounds(now, paths, most_rounds)
    # now every node but the roots has one edge, to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def _rounds(now: DataFrame, paths: list[str], most_rounds: int) -> DataFrame:
    """Rounds of both stars until nothing changes."""
    state = _state(now)
    for _ in range(most_rounds):
        old, paths = paths, []
        half = materialize(_star(now, paths, True), paths)
        now = materialize(_star(half, paths, False), paths)
        for p in [*old, *paths[:-1]]:
            drop_path(now.sparkSession, p)
        del paths[:-1]
        before, state = state, _state(now)
        if state == before:
            return now
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes, which changes with the set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
