"""Language-model scoring: a log-bilinear neural model over word classes, trained with noise-contrastive estimation in numpy.

Words are counted over all training texts. The commonest OWN words and the end of
a text are classes of their own; every other word, known or not, falls into a class
by its last two bytes. A word's probability is that of its class, given the classes
of the CONTEXT tokens before it, times its share (c + 1) of its class. The class
model is log-bilinear: a context's vector is the sum over its places of a vector of
the class there, scaled by the place's weights, and a class's logit is the product
of its own vector with it plus a bias. Training contrasts each token with noise
classes drawn by frequency; batched matrix products over all classes then give
logits and their exact normaliser, so log-probabilities are normalised.

Each document is read once into class numbers, a byte each, which are written to
the shared folder; training and scoring read those. Words beyond the HEAD commonest
aren't shipped to the workers: they meet their counts in a shuffled join.

Training runs on the executors over every training token: each task improves a copy
of the parameters on its own rows, and the copies are averaged by numbers of tokens
with partial aggregation, ROUNDS times over, each time on another part of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.common import materialize, table

#: Words whose counts are broadcast; classes; class numbers are bytes.
HEAD, CLASSES, OWN = 150_000, 256, 175
CONTEXT, WIDTH, NOISE, BATCH, ROUNDS, RATE = 6, 16, 48, 512, 3, 0.15
#: Distinct words that a worker counts before it passes the counts on.
COUNTED = 400_000
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END, ENDING = 0, 2


def held_out(doc_id: Column, parts: int = 7, at: int = 2) -> Column:
    """Whether crc32(doc_id as text) mod parts is at. A null id isn't held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % parts == at, F.lit(False))


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    for t in texts.cast(pa.binary()):
        yield (t.as_py() or b"").translate(_FOLD).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) of all texts: counted in the workers, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(found.items())
            found.clear()
            for at in range(0, len(items), 50_000):
                w, n = zip(*items[at : at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["word", "c"])

        for batch in batches:
            for words in _words(batch["text"]):
                found.update(words)
                if len(found) > COUNTED:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_threshold(counts: DataFrame, most: int) -> int:
    """The least count such that no more than most words have it or more."""
    by = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total, least = 0, 1_000_001
    # at most a million rows in the worst case; counts repeat, so far fewer are there
    for r in by.orderBy(F.desc("c")).toLocalIterator():
        total += r.n
        if total > most:
            break
        least = r.c
    return least


class Vocabulary:
    """Counts of the head words, classes, and what the base needs of all words."""

    def __init__(self, head: dict[bytes, int], tokens: int, distinct: int, ends: int, endings: dict[bytes, int], tail: dict[bytes, tuple[int, int]]):
        """endings: class by ending. tail: for each ending, sum of counts and number of words among words that are no class of their own."""
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        own = sorted(head, key=lambda w: (-head[w], w))[:OWN]
        self.endings = endings
        self.own = {w: i + 1 for i, w in enumerate(own)}
        # c + 1 of each word, and one for the unknown words of each class
        mass = np.zeros(CLASSES)
        mass[END] = ends + 1
        for w, i in self.own.items():
            mass[i] = head[w] + 1
        mass[OWN + 1 :] = 1
        for e, (c, n) in tail.items():
            mass[self.class_of_ending(e)] += c + n
        mass = np.maximum(mass, 1)
        self.total = tokens + distinct + 1
        self.log_mass = np.log10(mass / self.total)
        self.noise = mass / mass.sum()
        self.known = {w: (self.own.get(w) or self.class_of_ending(w[-ENDING:]), float(np.log10((c + 1) / self.total))) for w, c in head.items()}
        self.unknown, self.end = float(np.log10(1 / self.total)), float(np.log10((ends + 1) / self.total))

    def class_of_ending(self, e: bytes) -> int:
        return self.endings.get(e, OWN + 1)


def vocabulary(counts: DataFrame, texts: int, *, most: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary of written counts, and the least count of a head word. texts: training rows, each of which has one end."""
    least = head_threshold(counts, most)
    head = {bytes(r.word): r.c for r in counts.filter(F.col("c") >= least).collect()}
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("n")).first()
    own = sorted(head, key=lambda w: (-head[w], w))[:OWN]
    ending = F.expr(f"substring(word, greatest(length(word) - {ENDING - 1}, 1), {ENDING})")
    tail = {bytes(r.e): [r.c, r.n] for r in counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    for w in own:
        tail[w[-ENDING:]][0] -= head[w]
        tail[w[-ENDING:]][1] -= 1
    common = sorted(tail, key=lambda e: (-tail[e][0], e))[: CLASSES - OWN - 2]
    endings = {e: OWN + 2 + i for i, e in enumerate(common)}
    return Vocabulary(head, sums.c + texts, sums.n + (texts > 0), texts, endings, {e: tuple(x) for e, x in tail.items()}), least


def read_classes(docs: DataFrame, shipped) -> DataFrame:
    """(rid, doc_id, held_out, n_tokens, n_known, base, ids binary, rare array<binary>): base and n_known of the head words and the end alone; rare has the other words, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shipped.value
        known, endings, other = v.known.get, v.endings.get, OWN + 1
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n_tokens, n_known, base, ids, rare = [], [], [], [], []
                for words in _words(batch["text"]):
                    found = [known(w) for w in words]
                    new = [w for w, x in zip(words, found, strict=True) if x is None]
                    if new:
                        classes = bytes([x[0] if x is not None else endings(w[-ENDING:], other) for w, x in zip(words, found, strict=True)])
                    else:
                        classes = bytes([x[0] for x in found])
                    n_tokens.append(len(words) + 1)
                    n_known.append(len(words) - len(new) + (v.ends > 0))
                    base.append(sum([x[1] for x in found if x is not None]) + v.end)
                    ids.append(classes + b"\0")
                    rare.append(new)
                columns = [batch["rid"], batch["doc_id"], batch["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "rare"])

    return docs.select("rid", "doc_id", "held_out", "text").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids binary, rare array<binary>")


# ---- the log-bilinear model


def start(noise: np.ndarray, *, context: int = CONTEXT, width: int = WIDTH, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters that give every class its frequency, whatever the context."""
    rng = np.random.default_rng(seed)
    n = len(noise)
    return {
        "r": rng.normal(0, 0.1, (n, width)).astype("f4"),
        "q": rng.normal(0, 0.1, (n, width)).astype("f4"),
        "p": np.tile((0.8 ** np.arange(context))[:, None], (1, width)).astype("f4"),
        "b": np.log(noise).astype("f4"),
    }


def contexts(ids: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """Classes at 1, 2, ... places before each token; before the text there are ends."""
    padded = np.concatenate([np.zeros(context, np.uint8), ids])
    return np.stack([padded[context - i : len(padded) - i] for i in range(1, context + 1)])


def joined(texts: list[bytes], context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (context, tokens) and tokens of several texts, none looking into another."""
    whole = np.frombuffer((b"\0" * context).join([b"", *texts]), np.uint8)
    at = contexts(whole, context)
    keep = np.ones(len(whole), bool)
    end = 0
    for t in texts:
        keep[end : end + context] = False
        end += context + len(t)
    return at[:, keep], whole[keep]


def context_vectors(m: dict, at: np.ndarray) -> np.ndarray:
    out = m["r"][at[0]] * m["p"][0]
    for i in range(1, len(at)):
        out += m["r"][at[i]] * m["p"][i]
    return out


def log10_probabilities(m: dict, at: np.ndarray, tokens: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Normalised log10 probability of each token's class in its context."""
    out = np.empty(len(tokens))
    # the bias is a row of the product; a bound on the logits tells whether exp needs a guard
    q = np.vstack([m["q"].T, m["b"]]).astype("f4")
    width, ones = len(q) - 1, np.ones(q.shape[1], np.float32)
    longest = np.sqrt((m["q"] ** 2).sum(1).max())
    h = np.ones((min(chunk, len(tokens)), width + 1), np.float32)
    for i in range(0, len(tokens), chunk):
        here = tokens[i : i + chunk]
        h[: len(here), :width] = context_vectors(m, at[:, i : i + chunk])
        v = h[: len(here)]
        logits = v @ q
        own = logits[np.arange(len(here)), here].astype("f8")
        if np.sqrt((v[:, :width] ** 2).sum(1).max()) * longest + m["b"].max() > 80:
            np.minimum(logits, 80, out=logits)
        np.exp(logits, out=logits)
        out[i : i + chunk] = own - np.log((logits @ ones).astype("f8"))
    return out / np.log(10)


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """out[r] = the sum of the values at rows equal to r."""
    width = values.shape[1]
    places = (rows.astype(np.int64) * width)[:, None] + np.arange(width)
    return np.bincount(places.ravel(), values.ravel(), n * width).reshape(n, width).astype("f4")


def improve(m: dict, at: np.ndarray, tokens: np.ndarray, noise: np.ndarray, squares: dict, rng: np.random.Generator, *, negatives: int = NOISE, rate: float = RATE) -> None:
    """One step of noise-contrastive estimation on a batch, in place: every token against the same negatives draws from noise."""
    classes, width = m["q"].shape
    drawn = rng.choice(classes, negatives, p=noise)
    lift = np.log(negatives * noise).astype("f4")
    seen = m["r"][at]
    h = np.einsum("cnw,cw->nw", seen, m["p"])
    sigmoid = lambda x: np.float32(0.5) * (1 + np.tanh(np.float32(0.5) * x))
    q_own, q_drawn = m["q"][tokens], m["q"][drawn]
    own = 1 - sigmoid(np.einsum("ij,ij->i", h, q_own) + (m["b"] - lift)[tokens])
    others = -sigmoid(h @ q_drawn.T + (m["b"] - lift)[drawn])
    back = own[:, None] * q_own + others @ q_drawn
    back_each = back[None] * m["p"][:, None]
    g = {
        "r": _row_sums(at.ravel(), back_each.reshape(-1, width), classes),
        "q": _row_sums(np.concatenate([tokens, drawn]), np.concatenate([own[:, None] * h, others.T @ h]), classes),
        "p": np.einsum("nw,cnw->cw", back, seen),
        "b": (np.bincount(tokens, own, classes) + np.bincount(drawn, others.sum(0), classes)).astype("f4"),
    }
    n = np.float32(len(tokens))
    for k, x in g.items():
        x /= n
        squares[k] += x * x
        m[k] += rate * x / np.sqrt(squares[k] + 1e-8)


def train(read: DataFrame, v: Vocabulary, *, rounds: int = ROUNDS, batch: int = BATCH) -> dict[str, np.ndarray]:
    """Parameters after rounds over parts of the rows of read (rid, held_out, ids), every training row in one of them."""
    spark = read.sparkSession
    m = start(v.noise)
    shapes = {k: x.shape for k, x in m.items()}
    squares = {k: np.full(x.shape, 1e-4, "f4") for k, x in m.items()}
    rows = read.filter(~F.col("held_out"))
    for i in range(rounds):
        shipped = spark.sparkContext.broadcast((m, squares, v.noise))

        def learn(batches: Iterator[pa.RecordBatch], i: int = i, shipped=shipped) -> Iterator[pa.RecordBatch]:
            m, squares, noise = ({k: x.copy() for k, x in y.items()} if isinstance(y, dict) else y for y in shipped.value)
            rng = np.random.default_rng(i)
            n, held, size = 0, [], 0

            def fit(texts: list[bytes]) -> int:
                at, tokens = joined(texts)
                order = rng.permutation(len(tokens))
                for j in range(0, len(tokens), batch):
                    part = order[j : j + batch]
                    improve(m, at[:, part], tokens[part], noise, squares, rng)
                return len(tokens)

            for x in batches:
                for t in x["ids"]:
                    held.append(t.as_py())
                    size += len(held[-1])
                    if size > 200_000:
                        n += fit(held)
                        held, size = [], 0
            if held:
                n += fit(held)
            if n:
                flat = np.concatenate([x.ravel() for y in (m, squares) for x in y.values()]).astype("f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * n), pa.array(np.full(len(flat), n, np.int64))], ["i", "x", "n"])

        part = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(rounds)) == i).select("ids")
        # as many rows as there are parameters, whatever the corpus
        found = part.mapInArrow(learn, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
        shipped.unpersist()
        if found:
            flat = np.empty(len(found))
            for r in found:
                flat[r.i] = r.x
            parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes.values()] * 2)[:-1])
            both = [p.reshape(s).astype("f4") for p, s in zip(parts, [*shapes.values()] * 2, strict=True)]
            m, squares = dict(zip(m, both[: len(m)], strict=True)), dict(zip(m, both[len(m) :], strict=True))
    return m


def score(docs: DataFrame, *, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs (doc_id, text).

    A null text is empty and has its end alone. Repeated rows are scored each, and
    count each if they aren't held out; a null doc_id isn't. Without training rows
    every token is unknown, base_score is 0 and score that of equal classes. No rows
    give none. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = materialize(word_counts(rows.filter(~F.col("held_out"))))
    v, least = vocabulary(counts, rows.filter(~F.col("held_out")).count(), most=head)
    read = materialize(read_classes(rows, spark.sparkContext.broadcast(v)))
    m = train(read, v)
    shipped = spark.sparkContext.broadcast((m, v.log_mass))

    def lifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_mass = shipped.value
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [x.as_py() for x in part["ids"]]
                at, tokens = joined(texts)
                each = log10_probabilities(m, at, tokens) - log_mass[tokens]
                ends = np.cumsum([len(t) for t in texts])
                lift = np.add.reduceat(each, np.concatenate([[0], ends[:-1]]))
                names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(lift)], [*names, "lift"])

    scored = read.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(lifts, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lift double")
    # rare words of a text meet their counts; neither side can be hot, as a word of many texts is a head word
    asked = read.select("rid", F.explode("rare").alias("word"))
    tail = counts.filter(F.col("c") < least)
    one = asked.join(tail, "word", "left").groupBy("rid").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(v.total)))).alias("base_rare"), F.count("c").alias("n_rare"))
    out = scored.join(one, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), (F.col("base") + F.coalesce("base_rare", F.lit(0.0)) + F.col("lift")).alias("score"),
    )
    return out


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
