"""SentencePiece encoding and decoding.

viterbi() is the relational lattice: words are exploded into substrings no longer
than the longest piece, these meet the piece table in an equi-join, the edges of a
word are grouped and folded by a higher-order aggregate which carries the best score
and way to each place. It gives a unigram model's segmentation.

The public model at hand, however, merges pairs by rank (byte-pair encoding), and no
sum of scores over a lattice spells out its merges: the best path differs from the
model's own result for many words. So the query encodes whole texts by the library,
in Arrow batches, without a shuffle, and decodes the ids of each row where it is;
decode() does the same natively for ids by key.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.llm.common import table

SPACE = "▁"


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def piece_rows(model: bytes) -> list[tuple]:
    """The rows of piece_table(), by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            rows.append((i, p, sp.get_score(i), "byte", bytes([int(p[3:5], 16)])))
        elif sp.is_control(i) or sp.is_unknown(i):
            rows.append((i, p, sp.get_score(i), "control", b""))
        else:
            rows.append((i, p, sp.get_score(i), "text", p.replace(SPACE, " ").encode()))
    return rows


def piece_table(spark: SparkSession, model: bytes) -> DataFrame:
    """(id int, piece string, score double, kind string, value binary): what each id stands for; kind is text, byte or control."""
    return spark.createDataFrame(piece_rows(model), "id int, piece string, score double, kind string, value binary")


def viterbi(words: DataFrame, pieces: DataFrame, *, unknown: float = -1e9) -> DataFrame:
    """words with columns pieces array<string> and score double: the cut of word into pieces with the greatest sum of scores.

    words needs a column word and may have others, but for pieces and score, which
    are replaced; pieces has distinct piece string and score double. A character
    that no piece holds is a piece of score unknown. Of equally good ways the one
    whose last piece is longest wins, at every place. A null or empty word has no
    pieces and score 0. Repeated words come out each. The piece table is broadcast:
    its size is that of a vocabulary, whatever the corpus.
    """
    longest = pieces.agg(F.max(F.char_length("piece"))).first()[0] or 1
    distinct = words.select("word").filter("word != ''").distinct()
    # (start, stop) pairs of at most the longest piece
    spans = distinct.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("start")).select(
        "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("word") - F.col("start") + 1))).alias("n")
    )
    cut = spans.select("word", (F.col("start") - 1).alias("start"), (F.col("start") + F.col("n") - 1).alias("stop"), F.expr("substr(word, start, n)").alias("piece"))
    known = cut.join(F.broadcast(pieces.select("piece", F.col("score").cast("double").alias("score"))), "piece", "left")
    edges = known.filter("score is not null or stop = start + 1").withColumn("score", F.coalesce("score", F.lit(float(unknown))))
    edge = F.struct("stop", "start", "piece", "score")
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    way = "struct<score:double,at:int,last:string>"
    nothing = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("at"), F.lit("").alias("last")).cast(way))

    def step(state: Column, e: Column) -> Column:
        # ways[i] is the best way to place i; the edges come by stop, then start, so earlier places are settled
        new = F.struct((F.get(state, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("at"), e["piece"].alias("last")).cast(way)
        have = F.size(state) > e["stop"]
        better = new["score"] > F.get(state, e["stop"])["score"]
        return F.when(~have, F.concat(state, F.array(new))).when(better, F.concat(F.slice(state, F.lit(1), e["stop"]), F.array(new))).otherwise(state)

    best = lattice.select("word", F.aggregate("edges", nothing, step).alias("ways"))

    def back(state: Column, _: Column) -> Column:
        here = F.get(F.col("ways"), state["at"])
        return F.when(state["at"] > 0, F.struct(here["at"].alias("at"), F.concat(F.array(here["last"]), state["out"]).alias("out"))).otherwise(state)

    end = F.size("ways") - 1
    begin = F.struct(end.alias("at"), F.array().cast("array<string>").alias("out"))
    read = best.select("word", F.aggregate(F.sequence(F.lit(1), F.greatest(end, F.lit(1))), begin, back, lambda s: s["out"]).alias("pieces"), F.get(F.col("ways"), end)["score"].alias("score"))
    return words.drop("pieces", "score").join(read, "word", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast("array<string>"))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def encode(docs: DataFrame, *, model: bytes) -> DataFrame:
    """(doc_id, ids array<int>): the model's ids of each row's whole text, no control ids added.

    A null text is an empty one and has no ids. Repeated rows come out each, no
    rows give none. Other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [np.asarray(x, np.int32) for x in sp.encode([t or "" for t in batch["text"].to_pylist()], num_threads=1)]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int32()))
                crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, crc], ["doc_id", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, pieces: DataFrame, *, key: str = "row") -> DataFrame:
    """(key, text): the texts that the ids of each key stand for, natively; keys must be distinct.

    Bytes of byte ids are joined before they are read as UTF-8. The one space that
    encoding puts before a text is taken off. Control ids stand for nothing, and so
    do ids that the table lacks and null ones. No ids, or null, give an empty text.
    """
    places = encoded.select(key, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(pieces.select("id", "value")), "id", "left")
    order = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value"))))
    text = places.groupBy(key).agg(order.alias("parts")).select(key, F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["value"])), "")).cast("string").alias("text"))
    return text.select(key, F.when(F.startswith("text", F.lit(" ")), F.substring("text", 2, 2147483647)).otherwise(F.col("text")).alias("text"))


def decoded_text(ids: list[int], values: list[bytes]) -> str:
    """What decode() gives for one row's ids; values are the pieces' by id."""
    return b"".join([values[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def with_decoded(encoded: DataFrame, *, model: bytes) -> DataFrame:
    """encoded (doc_id, ids, ids_crc32) with decoded_sha256, the digest of the text that each row's ids stand for, and decoded_as_library, whether the library decodes them to the same text.

    Each row is decoded where it is, so no key is needed and nothing is shuffled.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast((model, [r[4] for r in piece_rows(model)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        proto, values = shipped.value
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids = [np.asarray(x.values).tolist() for x in batch["ids"]]
                mine = [decoded_text(x, values) for x in ids]
                same = [a == sp.decode(x) if x else not a for a, x in zip(mine, ids, strict=True)]
                digests = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in mine]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], batch["ids_crc32"], pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "ids_crc32", "decoded_sha256", "decoded_as_library"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, decoded_sha256 string, decoded_as_library boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, decoded_sha256, decoded_as_library of all whole documents."""
    model = model_bytes()
    both = with_decoded(encode(table(spark, sf_dir, "documents"), model=model), model=model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "ids_crc32", "decoded_sha256", "decoded_as_library")
