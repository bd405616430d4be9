"""Document fingerprints by improved consistent weighted sampling (Ioffe, 2010).

A text is a set of words weighted by how often they occur. For each of SAMPLES
numbers k a word draws, from hashes of itself and k, r and c from Gamma(2, 1) and a
uniform beta. With weight w, t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta + 1); the word with the least a, with its t, is the text's
sample k. Two texts agree in a sample with a probability that equals the sum of the
smaller weights over the sum of the larger ones, their generalised Jaccard
similarity, so the share of equal samples estimates it without bias.

Words are counted before they are sampled. ln a is packed in fixed point above 32
bits that name the sample, so one integer minimum finds both. Each text and its
edited text are sampled in one pass, as they share their words' draws.

The order by descending doc_id is made from ranges of ids, not in one task: rows lie
in buckets between quantiles of the ids, and a copy of each bucket's first row stands
after the last of the bucket before it. From then on rows of a bucket stay together,
so that the text is shuffled once and both aggregations need no shuffle.
Native throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.llm.common import SPACES, materialize, table

SAMPLES = 24
#: Rows to a bucket, about, and most buckets: their bounds are held by the driver.
BUCKET_ROWS, MOST_BUCKETS = 500, 4096
_LOW = (1 << 32) - 1


def draws(word: Column, k: Column) -> tuple[Column, Column]:
    """The two hashes from which a word (as its own hash) draws for sample k."""
    return F.xxhash64(word, k * 2), F.xxhash64(word, k * 2 + 1)


def _uniform(bits: Column, n: int) -> Column:
    return (bits.cast("double") + 0.5) / F.lit(float(1 << n))


def gammas(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(r, ln c, beta) of two hashes."""
    third = (1 << 21) - 1
    u1, u2, u3 = (_uniform(F.shiftrightunsigned(x, s).bitwiseAND(F.lit(third)), 21) for s in (43, 22, 1))
    u4, beta = _uniform(F.shiftrightunsigned(y, 32), 32), _uniform(y.bitwiseAND(F.lit(_LOW)), 32)
    return -F.ln(u1 * u2), F.ln(-F.ln(u3 * u4)), beta


def packed(weight: Column, x: Column, r: Column, log_c: Column, beta: Column) -> Column:
    """ln a in fixed point above the low half of x with t in it; null for weight 0. Less is nearer to being the sample."""
    t = F.floor(F.ln(weight.cast("double")) / r + beta)
    log_a = log_c - r * (t.cast("double") - beta + 1)
    # ln a lies between -100 and 27
    high = F.floor((F.greatest(F.least(log_a, F.lit(27.0)), F.lit(-100.0)) + 100) * float(1 << 24))
    return F.when(weight > 0, F.shiftleft(high, 32).bitwiseOR(x.bitwiseAND(F.lit(_LOW)).bitwiseXOR(t.bitwiseAND(F.lit(0xFFFF)))))


def sampled(counted: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, one array<long> of samples for each column of weights) from rows (keys, word long, weights).

    A row of a null word only keeps its keys. Keys without words have samples 0.
    """
    each = counted.select(*keys, "word", *weights, F.explode(F.array(*map(F.lit, range(samples)))).alias("k"))
    x, y = draws(F.col("word"), F.col("k"))
    drawn = each.select(*keys, "k", "word", *weights, x.alias("x"), y.alias("y"))
    r, log_c, beta = gammas(F.col("x"), F.col("y"))
    ready = drawn.select(*keys, "k", "word", *weights, "x", r.alias("r"), log_c.alias("log_c"), beta.alias("beta"))
    least = ready.groupBy(*keys, "k").agg(*[F.min(F.when(F.col("word").isNotNull(), packed(F.col(w), F.col("x"), F.col("r"), F.col("log_c"), F.col("beta")))).alias(w) for w in weights])
    name = lambda w: F.coalesce(F.col(w).bitwiseAND(F.lit(_LOW)), F.lit(0).cast("bigint")).alias(w)
    rows = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", *map(name, weights)))).alias("rows"))
    return rows.select(*keys, *[F.col("rows").getField(w).alias(w) for w in weights])


def counted(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, word long, columns as counts): how often each text column holds each word, by a 64-bit hash of the word; keys without words keep a row of a null word."""
    kinds = F.array(*[F.struct(F.col(c).alias("_text"), *[F.lit(int(c == d)).cast("bigint").alias(d) for d in columns]) for c in columns])
    one = texts.select(*keys, F.explode(kinds).alias("one"))
    words = one.select(*keys, *[F.col(f"one.{c}").alias(c) for c in columns], F.explode(F.split("one._text", SPACES)).alias("w"))
    return words.select(*keys, F.when(F.col("w") != "", F.xxhash64("w")).alias("word"), *columns).groupBy(*keys, "word").agg(*[F.sum(c).alias(c) for c in columns])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return sum((F.when(F.get(a, i) == F.get(b, i), 1).otherwise(0) for i in range(samples)), F.lit(0)) / F.lit(float(samples))


def written(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint string) for every row of docs (doc_id, text): 8 hex digits a sample. Null texts are empty; texts without words have zeros."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = sampled(counted(rows, ["rid", "doc_id"], ["text"]), ["rid", "doc_id"], ["text"], samples)
    return found.select("doc_id", written(F.col("text")).alias("fingerprint"))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the bounds (falling) are above doc_id, by binary search; all for a null."""
    if not bounds:
        return F.lit(0)
    n = 1 << (len(bounds)).bit_length()
    held = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds])
    steps = F.array(*[F.lit(n >> i) for i in range(1, n.bit_length())])
    step = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) > doc_id), at + s).otherwise(at)
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(F.aggregate(steps, F.lit(0), step))


def neighbours(docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows (b, pos, doc_id, text, next) by descending doc_id, and (b, number of rows, next bucket) of each bucket.

    next is the following row's text, after the last the first's. Rows that share an
    id stand by a hash of their texts; a null id comes last.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.select("doc_id")
    n = ids.count()
    wanted = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 10 * MOST_BUCKETS)).first()[0] if wanted > 1 else None
    bounds = sorted(set(cuts or []), reverse=True)
    rows = base.withColumn("b", _bucket(F.col("doc_id"), bounds)).withColumn("h", F.xxhash64("text"))
    # one row for each bucket, MOST_BUCKETS at most
    first = F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.shiftrightunsigned("h", 1), -F.col("h").bitwiseAND(F.lit(1)))
    heads = sorted(rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.max(first).alias("x")).select("b", "n", "x.doc_id").collect(), key=lambda r: r.b)
    order = [r.b for r in heads]
    after = dict(zip(order, [*order[1:], *order[:1]], strict=True))
    before = {b: a for a, b in after.items()}
    small = docs.sparkSession.createDataFrame([(r.b, r.doc_id, before[r.b]) for r in heads], "b int, head long, before int")
    copies = rows.join(F.broadcast(small), "b").filter(F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("before").alias("b"), "h", F.lit(1).alias("copy"))
    by = Window.partitionBy("b").orderBy("copy", F.desc("doc_id"), F.shiftrightunsigned("h", 1), F.col("h").bitwiseAND(F.lit(1)))
    both = rows.select("doc_id", "text", "b", "h", F.lit(0).alias("copy")).unionByName(copies)
    placed = both.select("b", "copy", "doc_id", "text", F.row_number().over(by).alias("pos"), F.lead("text").over(by).alias("next")).filter("copy = 0")
    return placed.select("b", "pos", "doc_id", "text", "next"), [(r.b, r.n, after[r.b]) for r in heads]


def compare(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    A null text is empty; an empty text has a fingerprint of zeros, like other
    empty ones. Repeated rows come out each. No rows give no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    placed, buckets = neighbours(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    texts = placed.select("b", "pos", "doc_id", n.cast("bigint").alias("n_chars"), F.col("text").alias("own"), edited.alias("edited"))
    keys = ["b", "pos"]
    found = sampled(counted(texts, keys, ["own", "edited"]), keys, ["own", "edited"], samples)
    info = texts.select(*keys, "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"))
    both = materialize(info.join(found, keys))
    turns = spark.createDataFrame(buckets, "b int, n long, following int")
    linked = both.join(F.broadcast(turns), "b").withColumn("nb", F.when(F.col("pos") < F.col("n"), F.col("b")).otherwise(F.col("following"))).withColumn("np", F.when(F.col("pos") < F.col("n"), F.col("pos") + 1).otherwise(1))
    other = both.select(F.col("b").alias("nb"), F.col("pos").alias("np"), F.col("own").alias("other"))
    return linked.join(other, ["nb", "np"]).select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("own"), F.col("other"), samples).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
