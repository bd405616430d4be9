"""Language model, fingerprints, top-k, pieces, toxicity and the pipeline against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from pagequery.llm import common, fingerprints, lm, sentencepieces, topk, toxicity
from tests.llm.helpers import no_documents, odd_documents

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- top-k


def slow_topk(rows, k=10):
    sound = [(i, n, [math.floor(1024 * x) for x in v]) for i, (n, v) in enumerate(rows) if v is not None and n is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v in sound:
        if n % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), m, j) for j, m, w in sound if j != i and len(w) == len(v))[:k]
            out += [(n, r + 1, m, -s) for r, (s, m, _) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "bins"), [(2048, 2048), (2, 16)])
def test_topk_against_brute_force(spark, block, bins):
    rng = np.random.default_rng(1)
    rows = [(i * 10, [float(np.float32(x)) for x in rng.normal(0, 0.3, 6)]) for i in range(60)]
    rows += [(700 + i, [0.5] * 6) for i in range(30)]  # a group of ties
    rows += [(800, None), (900, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1100, [float("inf")] * 6), (1200, []), (1300, [1.0, 2.0]), (1400, [-1.0, 3.0]), (0, [0.0] * 6), (0, [0.0] * 6)]
    df = spark.createDataFrame([(n, v, 1, "x") for n, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    got = topk.search(topk.integer_vectors(df), "vec_id % 100 = 0", block=block, bins=bins)
    assert sorted(map(tuple, got.collect())) == slow_topk(rows)
    assert topk.search(topk.integer_vectors(df.limit(0)), "vec_id % 100 = 0").count() == 0


def test_topk_of_large_numbers(spark):
    rows = [(i, [float(i) * 1e6, -1e6]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(topk.integer_vectors(df), "vec_id = 0", k=3)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, 2, 3]
    one = topk.search(topk.integer_vectors(df.limit(1)), "true")
    assert one.count() == 0


def test_topk_of_dense_scores(spark):
    # widths 4096, 2 and 1: many scores lie within 2048 above the bin of the kth
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.15, 8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.search(topk.integer_vectors(df), "vec_id % 100 = 0", bins=2048).collect()
    assert collections.Counter(r.query_id for r in got) == {q: 10 for q in range(0, 600, 100)}
    assert sorted(map(tuple, got)) == slow_topk(rows)


# ---- pieces


def slow_viterbi(word, table):
    best = [(0.0, [])] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = word[i:j]
            s = table.get(p, -1e9 if j == i + 1 else None)
            if s is not None and (best[j] is None or best[i][0] + s > best[j][0]):
                best[j] = (best[i][0] + s, [*best[i][1], p])
    return best[len(word)]


def test_viterbi_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pieces = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.0, "bc": -3.5, "abc": -4.0, "ca": -4.0, "cab": -6.0, "\U0001f600": -1.0}
    found = ["".join(rng.choice(list("abcdé\U0001f600"), rng.integers(0, 9))) for _ in range(80)]
    df = spark.createDataFrame([(w, "x") for w in [*found, None, "", "abc" * 40]], "word string, score string")
    table = spark.createDataFrame(list(pieces.items()), "piece string, score double")
    got = sentencepieces.viterbi(df, table).collect()
    assert len(got) == len(found) + 3
    for r in got:
        s, way = slow_viterbi(r.word or "", pieces)
        assert r.score == pytest.approx(s) and list(r.pieces) == way, r.word
    assert sentencepieces.viterbi(df.limit(0), table).count() == 0


def test_encoding_is_the_librarys_and_comes_back(spark):
    import sentencepiece

    model = sentencepieces.model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = odd_documents(spark)
    got = sentencepieces.encode(docs, model=model)
    rows = {r.doc_id: r for r in got.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, t in texts.items():
        assert list(rows[i].ids) == sp.encode(t)
        assert rows[i].ids_crc32 == zlib.crc32(np.asarray(rows[i].ids, "<u4").tobytes())
    assert got.count() == docs.count()
    table = sentencepieces.piece_table(spark, model)
    back = {r.doc_id: r.text for r in sentencepieces.decode(got.dropDuplicates(["doc_id"]), table, key="doc_id").collect()}
    assert back == {i: sp.decode(list(rows[i].ids)) for i in texts}
    assert sum(back[i] == t for i, t in texts.items()) >= len(texts) - 2  # compatibility characters are normalised
    assert sentencepieces.encode(no_documents(spark), model=model).count() == 0


def test_sentencepiece_query_decodes_every_document(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.model_bytes())
    rows = sentencepieces.op7_sentencepiece(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.decoded_as_library and r.decoded_sha256 == hashlib.sha256(sp.decode(list(r.ids)).encode()).hexdigest() for r in rows)
    model = sentencepieces.model_bytes()
    odd = sentencepieces.with_decoded(sentencepieces.encode(odd_documents(spark), model=model), model=model).collect()
    assert len(odd) == odd_documents(spark).count() and all(r.decoded_as_library for r in odd)


# ---- fingerprints


def test_edited_texts_and_order(spark):
    docs = odd_documents(spark).dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert len(got) == len(rows)
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        a, b = r.text or "", after.text or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert (got[r.doc_id].n_chars, got[r.doc_id].edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        mine, other = got[r.doc_id].fingerprint, got[after.doc_id].fingerprint
        parts = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
        assert got[r.doc_id].near_next == pytest.approx(np.mean([x == y for x, y in zip(parts(mine), parts(other))]))
        assert got[r.doc_id].near_edited == pytest.approx(np.mean([x == y for x, y in zip(parts(mine), parts(got[r.doc_id].edited_fingerprint))]))
    by = collections.defaultdict(set)
    for r in rows:
        by[r.text or ""].add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert fingerprints.compare(no_documents(spark)).count() == 0
    assert fingerprints.compare(odd_documents(spark)).count() == odd_documents(spark).count()
    one = fingerprints.compare(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_buckets_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    docs = spark.createDataFrame([(i * i, f"w{i} x") for i in range(100)] + [(None, "none"), (None, "at all")], "doc_id long, text string")
    placed, buckets = fingerprints.neighbours(docs)
    assert len(buckets) > 5
    rows = placed.collect()
    ids = [None if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: (r.b, r.pos))]
    assert ids == [i * i for i in range(99, -1, -1)] + [None, None]
    follow = {r.text: r.next for r in rows}
    assert all(follow[f"w{i} x"] == f"w{i - 1} x" for i in range(1, 100)) and set(follow.values()) == set(follow)


def test_collisions_estimate_generalised_jaccard(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{j}" for j in range(60)], 80, p=np.random.default_rng(i).dirichlet(np.ones(60)))) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df, samples=512).collect()}
    errors = []
    for i in range(12):
        for j in range(i):
            a, b = collections.Counter(texts[i].split()), collections.Counter(texts[j].split())
            near = np.mean([got[i][k : k + 8] == got[j][k : k + 8] for k in range(0, 4096, 8)])
            errors.append(near - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.035


# ---- language model


def test_base_scores_and_model(spark):
    docs = odd_documents(spark)
    for head in (lm.HEAD, 40):
        rows = lm.score(docs, head=head).collect()
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
        c = collections.Counter()
        for i, t in texts:
            if not held[i]:
                c.update([*words(t), None])
        n, v = sum(c.values()), len(c)
        want = {i: [*words(t), None] for i, t in texts}
        assert len(rows) == len(texts)
        for r in rows:
            found = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(found), sum(x in c for x in found), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in found))
            assert math.isfinite(r.score) and r.score < 0
    assert lm.score(no_documents(spark)).count() == 0
    nulls = lm.score(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert nulls[0].n_tokens == 1 and nulls[0].held_out is False
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    alone = lm.score(spark.createDataFrame([(i, "never seen") for i in out], "doc_id long, text string")).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_model_is_normalised_and_learns(spark):
    noise = np.arange(1, 257) / np.arange(1, 257).sum()
    m = lm.start(noise)
    rng, squares = np.random.default_rng(0), {k: np.full(x.shape, 1e-4, "f4") for k, x in m.items()}
    texts = [bytes([(7 * i + 3 * j) % 50 for i in range(60)]) for j in range(40)]
    at, tokens = lm.joined(texts)
    assert at.shape == (lm.CONTEXT, 2400) and at[0, 60] == 0 and at[0, 61] == tokens[60] and at[1, 61] == 0
    before = lm.log10_probabilities(m, at, tokens).mean()
    for _ in range(60):
        lm.improve(m, at, tokens, noise, squares, rng)
    assert lm.log10_probabilities(m, at, tokens).mean() > before + 0.5
    every = lm.log10_probabilities(m, np.repeat(at[:, 70:71], 256, 1), np.arange(256))
    assert (10.0**every).sum() == pytest.approx(1, abs=1e-4)


def test_lm_query_beats_its_base(spark):
    rows = lm.op3_lm_score(spark, SF).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# ---- toxicity


def toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["the", "an", "ing", "er", "on", "tion", "ha", "wh", "ed", "st", "ble", "re"]
    bad = ["idiot", "worthless", "disgusting", "pathetic"]
    out = []
    for i in range(n):
        y = int(i % 3 == 0)
        out.append((" ".join(rng.choice(bad) if y and rng.random() < 0.08 else "".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(120)), y))
    return out


def test_toxicity_on_held_out_rows(spark):
    model = toxicity.train(toxic_rows(400, 1))
    rows = [(i, t, y) for i, (t, y) in enumerate(toxic_rows(150, 2))]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, y int"), model).collect()
    assert np.mean([(r.toxicity >= 0.5) == bool(r.y) for r in got]) > 0.95


def test_toxicity_edges(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train([]) is None and toxicity.train([("a", 1)] * 4) is None
    assert toxicity.train([("a b", 1), ("", 1), ("c d", 0), (None, 0)] * 3) is not None
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    model = toxicity.train(toxic_rows(60, 3))
    scores = toxicity.score(docs, model)
    assert scores.count() == docs.count() and scores.filter("toxicity < 0 or toxicity > 1 or toxicity is null").count() == 0
    assert toxicity.score(no_documents(spark), model).count() == 0
    assert toxicity.words_of("One\x0bTWO é x") == [b"one", b"two", "é x".encode()]
    parts = toxicity.windows([b"a" * 200, b"b"])
    assert b"".join(parts).replace(b" ", b"") == b"a" * 200 + b"b" and toxicity.windows([]) == [b" "]


def test_toxicity_keeps_columns_of_any_name(spark):
    rows = [(i if i % 4 else None, t, 1.5, "u") for i, (t, _) in enumerate(toxic_rows(40, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double, _toxicity string")
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(toxic_rows(40, 5))], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() <= 40
    assert {(r.toxicity, r._toxicity) for r in kept.collect()} == {(1.5, "u")}
    assert toxicity.keep_clean(no_documents(spark), labels).count() == 0


def test_toxicity_samples_whole_texts_within_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (100 * i), 0) for i in range(1, 30)] + [(5, "y", 0)], "doc_id long, text string, other int")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 40)] + [(50, 0, None)], "doc_id long, quality int, toxic int")
    whole, odds = toxicity.sample(docs, labels)
    trained = [i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(len(t) for t, _ in whole) == sorted(100 * i for i in trained) and odds > 0
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 5000)
    some, _ = toxicity.sample(docs, labels)
    assert 0 < len(some) < len(whole) and sum(len(t) for t, _ in some) <= 5000 and all(len(t) % 100 == 0 for t, _ in some)


def test_toxicity_query(spark):
    rows = toxicity.op10_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)


# ---- pipeline


def test_pipeline_and_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, now, SF))
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in now.select("doc_id").collect()}
        now = after
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in now.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, last.select("doc_id", "piece", "length").collect()))
