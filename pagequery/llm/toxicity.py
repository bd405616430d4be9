"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A
text is cut into windows of about WINDOW bytes at its white space, and each window
is compressed twice: with the ordinary dictionary, and with the toxic one before
it. Both dictionaries have one length and hold the ordinary content at the same
places, so what the toxic content saves is all that parts the two lengths. The
toxic dictionary learns from those words of toxic texts that hold a run of letters
which is much commoner there than in ordinary texts; whole toxic texts would fill
it with ordinary words. Statistics of the windows' differences give the score
through a logistic curve, fitted on half of the sampled rows that the dictionaries
haven't seen, and its threshold is part of the fit.

Training takes a bounded sample of labelled rows on the driver: SAMPLE rows of each
label at most, by a hash of the id, with their whole texts, and SAMPLE_CHARS characters
in all; a row whose text would go beyond that is passed over. The settings below are
those with the least logistic loss in a fourfold split of the training rows alone.
Scoring is a map over all rows and whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.common import spare, table

SAMPLE, SAMPLE_CHARS = (4000, 8000), 48_000_000
WINDOW, RUN, LEVEL = 64, 6, 3
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 4096
#: A run marks toxic words if it is in LEAST toxic texts, TIMES as common there as in ordinary ones, and SURE deviations beyond what is expected.
LEAST, TIMES, SURE = 3, 4, 4.5
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32(doc_id as text) mod parts is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % parts == 0, F.lit(True))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    return folded(text).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The words in order, as many to a window as fit; a longer word is cut. At least one window."""
    out, now, n = [], [], 0
    for w in words:
        for at in range(0, len(w), size):
            part = w[at : at + size]
            if n and n + len(part) >= size:
                out.append(b" ".join(now) + b" ")
                now, n = [], 0
            now.append(part)
            n += len(part) + 1
    out.append(b" ".join(now) + b" ")
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary's content. zstandard can't train on few samples; those are the content themselves then."""
    import zstandard

    if sum(map(len, samples)) > 10 * size and len(samples) > 20:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def measure(model: Model):
    """words -> features: the greatest saving of a window, the mean of the three greatest, means over all, and the share that saves 3 bytes or more."""
    # the toxic content's place in the ordinary dictionary holds bytes that no text has
    filler = bytes(0xF8 + i * 37 % 8 for i in range(len(model.toxic)))
    toxic, ordinary = _compressor(model.toxic + model.ordinary), _compressor(filler + model.ordinary)

    def features(words: list[bytes]) -> tuple[float, ...]:
        x = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(words)), reverse=True)
        n = len(x)
        return x[0], sum(x[:3]) / min(n, 3), sum(v - 1 for v in x if v > 1) / (n + 3), sum(x) / (n + 5), sum(v >= 3 for v in x) / n

    return features


def _runs(words: list[bytes]) -> set[bytes]:
    return {w[i : i + RUN] for x in set(words) for w in (b" " + x + b" ",) for i in range(len(w) - RUN + 1)}


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weights of the columns of x and a constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def train(rows: list[tuple[str, int]], odds: float | None = None) -> Model | None:
    """A model from (text, 1 for toxic else 0); None unless there are both.

    odds is the number of toxic rows over that of ordinary ones where rows come
    from; rows may hold them in another proportion.
    """
    # texts are split into words where they are used: the words of all together would take many times their room
    read = [(folded(t), y) for t, y in rows]
    halves = [read[0::2], read[1::2]]
    if any(len({y for _, y in h}) < 2 for h in halves):
        return None
    toxic, ordinary = ([w for w, y in halves[0] if y == k] for k in (1, 0))

    def content(toxic, ordinary) -> tuple[bytes, bytes]:
        a, b = Counter(), Counter()
        for x in toxic:
            a.update(_runs(x.split()))
        for x in ordinary:
            b.update(_runs(x.split()))
        share = len(toxic) / len(ordinary)
        strong = {g for g, n in a.items() if n >= LEAST and n > TIMES * b[g] * share and n - b[g] * share > SURE * math.sqrt(b[g] * share + 1)}
        marked = lambda w: any(g in strong for g in _runs([w]))
        chosen = [b" " + b" ".join(x) + b" " for x in ([w for w in t.split() if marked(w)] for t in toxic) if x]
        # every ordinary text gives windows spread over it, so that long ones don't crowd out the rest
        plain = [w for t in ordinary for found in (windows(t.split()),) for w in found[:: max(1, len(found) // 30)]]
        return _trained(TOXIC_BYTES, chosen), _trained(ORDINARY_BYTES, plain)

    def table_of(model: Model, read) -> np.ndarray:
        features = measure(model)
        return np.array([features(t.split()) for t, _ in read], float)

    # the curve is fitted on rows that its dictionaries haven't seen; those in use have seen all
    first = Model(*content(toxic, ordinary), ())
    weights = _logistic(table_of(first, halves[1]), np.array([y for _, y in halves[1]], float))
    if odds:
        fitted = sum(y for _, y in halves[1]) / sum(1 - y for _, y in halves[1])
        weights = (*weights[:-1], weights[-1] + math.log(odds / fitted))
    whole = content(*([w for w, y in read if y == k] for k in (1, 0)))
    return Model(*whole, weights)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float | None]:
    """The bounded training sample of whole texts, and the odds of toxic rows among all that it comes from.

    It has up to SAMPLE[1] ordinary and SAMPLE[0] toxic rows of labels that aren't held
    out, in the order of a hash, and SAMPLE_CHARS characters in all at most.

    An id with several labels counts as toxic if one says so; null labels are left out.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id")]
    ids = [r for value, most in ((1, SAMPLE[0]), (0, SAMPLE[1])) for r in known.filter(F.col("toxic") == value).orderBy(*order).limit(most).collect()]
    if not ids:
        return [], None
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    take = lambda rows: own.join(F.broadcast(spark.createDataFrame(rows, "doc_id long, y int")), "doc_id")  # noqa: E731  at most SAMPLE rows
    labelled = [(r.doc_id, int(r.toxic)) for r in ids]
    # rows that repeat an id give one row of the sample
    sizes = {r.doc_id: r.n for r in take(labelled).groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n")).collect()}
    chosen, room = [], SAMPLE_CHARS
    # neither order nor label may follow from the place in the list
    for i, y in sorted(labelled, key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0])):
        if i in sizes and sizes[i] <= room:
            room -= sizes[i]
            chosen.append((i, y))
    if not chosen:
        return [], None
    texts = {r.doc_id: r.text for r in take(chosen).groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(texts[i], y) for i, y in chosen], n[1] / n[0] if n.get(0) and n.get(1) else None


def score(docs: DataFrame, model: Model | None, *, into: str = "toxicity") -> DataFrame:
    """docs with a column into double, 0 to 1, from whole texts; an old one of that name is replaced, all others stay.

    A null or empty text is one empty window. Repeated rows and rows without an id are
    scored each. Without a model every score is 0. An empty table gives no rows.
    """
    docs = docs.drop(into)
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        features, weights = measure(model), np.array(model.weights)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            x = np.array([features(words_of(t.as_py())) for t in batch.column(at)], float).reshape(-1, len(weights) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, into])

    schema = docs.withColumn(into, F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose toxicity is below threshold, with all their columns, whatever their names.

    A null text is kept, as an empty one scores low. Repeated rows and rows without an
    id are judged each. Without labels of both kinds all rows stay.
    """
    into = spare(docs.columns, "_toxicity")
    return score(docs, train(*sample(docs, labels)), into=into).filter(F.col(into) < threshold).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a prediction for every whole document, by a model of labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score(docs, train(*sample(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
