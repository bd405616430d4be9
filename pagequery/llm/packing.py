"""Bounded-space online best-fit packing of tokenised documents into sequences of a fixed length.

Tokenising is a map over the documents; from there on only the lengths of pieces
move. Pieces are dealt by a hash of their row's number into groups of about
GROUP_ROWS, as many as the input needs, so that no key decides how many rows a task
gets. A group's pieces arrive one by one in the order of that hash, which is no
order of lengths, and each goes into the open bin with the least free space that
still holds it. Open bins hang on a bitset keyed by free space, so the best fit is
the lowest set bit at or above the length. OPEN_BINS bins may be open; where one
more is needed, the fullest closes first. A group leaves some half-filled bins at
its end, about ten of thousands.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm.common import materialize, spare, table

GROUP_ROWS, OPEN_BINS, CAPACITY, END = 16384, 256, 4096, 1
#: Words whose ids a worker keeps; those that come later are encoded again where they recur.
KEPT_WORDS = 500_000
#: New words to a string, and what parts them.
TOGETHER, MARK = 256, b"\x01"
#: Words of these letters, with stops after them, are known by their letters in lower case.
#: Words of letters of more bytes than these are left to the library, as each merge is a round.
LONG = 64
LETTERS, STOPS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), b".,;:!?"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


class Merges:
    """The merges of a byte-pair vocabulary with word ends, over many words at once.

    Every word is the symbols of its bytes, the last with the end mark. In each round
    every word that still has a pair of the table merges its pair of least rank, the
    leftmost of equal ones, and words without one leave; pairs are looked up anew only
    beside a merge. So a round costs a few passes over arrays, whatever the words.
    """

    NONE = np.int64(1 << 40)

    def __init__(self, model: str):
        parts = json.loads(model)["model"]
        vocab, end = parts["vocab"], parts.get("end_of_word_suffix") or ""
        # the letters that stand for bytes: printable ones for themselves, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in parts["merges"]]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, which isn't empty, as little-endian unsigned 32-bit numbers."""
        out = [b""] * len(words)
        count = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol, last, names = self.inner[flat], np.cumsum(count) - 1, np.arange(len(words))
        symbol[last] = self.last[flat[last]]
        rank = np.full(len(flat), self.NONE)
        rank[:-1] = self.rank(symbol[:-1], symbol[1:])
        rank[last] = self.NONE
        while len(names):
            first = np.cumsum(count) - count
            best = np.minimum.reduceat(rank, first)
            done = best == self.NONE
            if done.any():
                whole, n = symbol[np.repeat(done, count)].astype("<u4").tobytes(), 4 * np.cumsum(count[done])
                for name, a, b in zip(names[done].tolist(), [0, *n[:-1].tolist()], n.tolist(), strict=True):
                    out[name] = whole[a:b]
                stay = np.repeat(~done, count)
                symbol, rank, names, count, best = symbol[stay], rank[stay], names[~done], count[~done], best[~done]
                if not len(names):
                    break
            owner = np.repeat(np.arange(len(names)), count)
            hits = np.flatnonzero(rank == best[owner])
            at = hits[np.concatenate([[True], np.diff(owner[hits]) != 0])]
            symbol[at] = self.made[best]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, rank, owner = symbol[stay], rank[stay], owner[stay]
            count = count - 1
            at = at - np.arange(len(at))
            for p in (at[at > 0] - 1, at):
                right = np.minimum(p + 1, len(symbol) - 1)
                rank[p] = np.where((right > p) & (owner[right] == owner[p]), self.rank(symbol[p], symbol[right]), self.NONE)
        return out


#: The encoders of this process, by vocabulary: a worker keeps what it knows from task to task.
_ENCODERS: dict[int, object] = {}


def word_encoder(model: str):
    """The encoder of a vocabulary in this process, made once."""
    name = zlib.crc32(model.encode())
    if name not in _ENCODERS:
        _ENCODERS[name] = _word_encoder(model)
    return _ENCODERS[name]


def _word_encoder(model: str):
    """ids of texts, as bytes of little-endian unsigned 32-bit numbers, word by word.

    The tokenizer's own rules part words at white space and never look across it,
    so a text's ids are its words' ids in a row, and each word is encoded once
    while there is room to keep it. New words of letters are merged many at once;
    others, and very long ones, are encoded by the library many to a string, parted
    by a control character whose id tells where the next one begins.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold memory
    from tokenizers import Tokenizer

    tokenizer, merges, known, parts_known = Tokenizer.from_str(model), Merges(model), {}, {}
    alone = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    mark = alone(MARK.decode())

    def fresh(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        plain = [w for w in words if MARK not in w] if len(mark) == 1 else []
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            ids = np.asarray(alone((b" " + MARK + b" ").join(part).decode("utf-8", "replace")), dtype="<u4")
            cuts = np.flatnonzero(ids == mark[0])
            if len(cuts) == len(part) - 1:
                whole = ids.tobytes()
                bounds = [0, *(4 * (cuts + 1)).tolist()]
                yield from zip(part, (whole[a:b] for a, b in zip(bounds, [*(4 * cuts).tolist(), len(whole)], strict=True)), strict=True)
            else:
                yield from ((w, np.asarray(alone(w.decode("utf-8", "replace")), dtype="<u4").tobytes()) for w in part)
        if len(plain) < len(words):
            yield from ((w, np.asarray(alone(w.decode("utf-8", "replace")), dtype="<u4").tobytes()) for w in words if MARK in w or not plain)

    def stems(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """fresh() of words, by way of their lower-cased letters and the stops after them where they are of that simple form: the tokenizer parts and lower-cases them so."""
        simple, rest, missing = [], [], set()
        if len(parts_known) + 2 * len(words) > KEPT_WORDS:
            parts_known.clear()
        for w in words:
            stem = w.rstrip(STOPS)
            if stem.isalpha():  # of bytes: ASCII letters only
                low = stem.lower()
            elif LETTERS.fullmatch(text := stem.decode("utf-8", "replace")):
                low = text.lower().encode()
            else:
                rest.append(w)
                continue
            tail = w[len(stem) :]
            if low not in parts_known:
                missing.add(low)
            if tail not in parts_known:
                missing.add(tail)
            simple.append((w, low, tail))
        missing.discard(b"")
        short = [w for w in missing if len(w) <= LONG and w[-1] not in STOPS]
        parts_known.update(zip(short, merges.encode(short), strict=True))
        parts_known.update(fresh([w for w in missing if len(w) > LONG or w[-1] in STOPS]))
        parts_known[b""] = b""
        for w, low, tail in simple:
            yield w, parts_known[low] + parts_known[tail]
        yield from fresh(rest)

    def encode(texts: list[str]) -> Iterator[bytes]:
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        new = [w for w in set().union(*words) if w not in known]
        if len(known) + len(new) <= KEPT_WORDS:
            known.update(stems(new))
            for ws in words:
                yield b"".join(map(known.__getitem__, ws))
        else:
            # what is new now is known for these texts alone
            extra = dict(stems(new))
            for ws in words:
                yield b"".join([known.get(w) or extra.get(w, b"") for w in ws])

    return encode


def pieces(docs: DataFrame, *, model: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut every capacity ids.

    A null or empty text is the end id alone. Repeated rows give pieces each.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    tail = np.asarray([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out = [[], [], [], [], []]
                for doc, ids in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                    ids += tail
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        for column, x in zip(out, (doc, n, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths, capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Each length's bin (from 0) and place in it, in the order given."""
    bins, offsets, free = [], [], 0
    by_space: dict[int, list[int]] = {}
    made = opened = 0
    for n in lengths:
        fitting = free >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            stack = by_space[space]
            b = stack.pop()
            if not stack:
                free ^= 1 << space
        else:
            if opened == open_bins:
                least = (free & -free).bit_length() - 1
                by_space[least].pop()
                if not by_space[least]:
                    free ^= 1 << least
                opened -= 1
            b, space = made, capacity
            made += 1
            opened += 1
        bins.append(b)
        offsets.append(capacity - space)
        if space > n:
            by_space.setdefault(space - n, []).append(b)
            free |= 1 << (space - n)
        else:
            opened -= 1
    return bins, offsets


def pack(found: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """found with sequence_id long and offset long; found needs length, of 1 to capacity, and may have any other columns.

    Columns named sequence_id or offset are replaced. Equal rows, and rows without an
    id, are packed each. A task that is run again packs alike, as rows keep their
    numbers while found is read in the same order. Empty input gives no rows.
    """
    found = found.drop("sequence_id", "offset")
    group = spare(found.columns, "_group")
    turn = spare(found.columns, "_turn")
    groups = max(1, -(-found.count() // group_rows))
    schema = found.select(*found.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            whole = pa.Table.from_batches(held)
            number = whole[group][0].as_py()
            bins, offsets = best_fit(whole["length"].to_pylist(), capacity, open_bins)
            # as many bins as pieces at most, so 2^32 a group are enough
            whole = whole.drop_columns([group, turn]).append_column("sequence_id", pa.array(np.asarray(bins, "i8") + (number << 32))).append_column("offset", pa.array(offsets, pa.int64()))
            held.clear()
            yield from whole.to_batches()

        for batch in batches:
            keys = np.asarray(batch[group])
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1][group][0].as_py() != keys[a]:
                    yield from packed()
                held.append(batch.slice(a, b - a))
        yield from packed()

    dealt = found.withColumn(turn, F.xxhash64(F.monotonically_increasing_id())).withColumn(group, F.pmod(F.col(turn), F.lit(groups)))
    return dealt.repartition(groups, group).sortWithinPartitions(group, turn).mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, *, model: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces of docs (doc_id, text).

    A null or empty text is one piece, the end id. Repeated rows and rows without an
    id are packed each; an empty table gives no rows; other columns are ignored.
    """
    return pack(materialize(pieces(docs, model=model, capacity=capacity, end=end)), capacity=capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, as pack_documents() does it."""
    return pack_documents(table(spark, sf_dir, "documents"), model=vocabulary())
