"""URL filter, SimHash, sharding, packing and secret scans against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from pagequery.llm import components, packing, secrets, sharding, simhash, url_filter
from tests.llm.helpers import no_documents, odd_documents

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 1), (None, 3), (4, 1), (30, 31), (31, 32), (32, 33), (33, 30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30, 32: 30, 33: 30}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in components.components(path).collect()} == {0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [250_000, 40])
def test_components_of_many_shapes(spark, chunk):
    rng = np.random.default_rng(8)
    edges = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2001 + i) for i in range(90)] + [(-5, 3000)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7), chunk=chunk).collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len(touched) and {r.node: r.component for r in got} == {x: find(x) for x in touched}


# ---- url filter

PAGES = "page_id long, url string, html string, host string, rule string"


def test_url_parts_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/7?x#y", None, "h", "r"),
        (2, "https://example.com/en/8", "", "h", "r"),
        (3, "https://notexample.com/en/7", "", "h", "r"),
        (4, "nothing", "", "h", "r"),
        (5, None, None, "h", "r"),
        (6, "x://b.example.net/de/85#z", "", "h", "r"),
        (7, "x://b.example.net/de/7", "", "h", "r"),
        (8, "x://q.org?es", "", "h", "r"),
        (9, "a://b.org://c/d", "", "h", "r"),
        (9, "a://b.org://c/d", "", "h", "r"),
    ]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"),
        (2, "example.com", "/en/8", "com/en/", "block"),
        (3, "notexample.com", "/en/7", "com/en/", "block"),
        (4, "", "", None, "allow"),
        (5, "", "", None, "allow"),
        (6, "b.example.net", "/de/85", "example.net/de/8", "block"),
        (7, "b.example.net", "/de/7", "net/de/", "allow"),
        (8, "q.org", "", None, "allow"),
        (9, "b.org:", "//c/d", None, "allow"),
    }
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_and_distrust_follow_the_links(spark):
    pages = [
        (1, "http://good.net/de/1", '<a href="http://friend.x/a">f</a> <a HREF=//friend.x/b>', "", ""),
        (2, "http://friend.x/1", "<a href='https://far.x/'>", "", ""),
        (3, "http://spammer.x/1", '<a href="http://bad.org/es/1">', "", ""),
        (4, "http://booster.x/1", '<a href="http://spammer.x/2">', "", ""),
        (5, "http://bad.org/es/1", "", "", ""),
        (6, "http://bad.org/other", "", "", ""),
        (7, "http://far.x/1", '<a href="http://bad.org/">', "", ""),
        (8, "http://alone.x/1", '<a href="/only/here">', "", ""),
    ]
    df = spark.createDataFrame(pages, PAGES)
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: got[6], 7: got[7], 8: "allow"}
    # brute force: dense vectors
    hosts = ["good.net", "friend.x", "far.x", "spammer.x", "booster.x", "bad.org", "alone.x"]
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((7, 7))
    for a, b in (("good.net", "friend.x"), ("friend.x", "far.x"), ("spammer.x", "bad.org"), ("booster.x", "spammer.x"), ("far.x", "bad.org")):
        m[at[a], at[b]] = 1
    flow = lambda w, s: [x := s] and [x := 0.85 * (w / np.maximum(w.sum(1, keepdims=True), 1)).T @ x + 0.15 * s for _ in range(10)][-1]
    s_t, s_d = np.zeros(7), np.zeros(7)
    s_t[at["good.net"]], s_d[at["bad.org"]] = 1, 0.5
    t, d = flow(m, s_t), flow(m.T, s_d)
    assert (got[7] == "block") == bool(d[at["far.x"]] > t[at["far.x"]])
    assert (got[6] == "block") == bool(d[at["bad.org"]] > t[at["bad.org"]])


def test_scores_settle_on_long_chains_and_hot_hosts(spark):
    rng = np.random.default_rng(12)
    hosts = [f"h{i}" for i in range(60)]
    links = collections.Counter()
    for i in range(14):
        links[f"h{i}", f"h{i + 1}"] += 1  # a chain of more hosts than ten rounds walk
    for i in range(15, 50):
        links[f"h{i}", "h55"] += int(rng.integers(1, 4))  # a host that most link to
        links["h55", f"h{i}"] += 1
    for _ in range(40):
        a, b = (int(x) for x in rng.integers(15, 60, 2))
        if a != b:
            links[f"h{a}", f"h{b}"] += 1
    seeds = [("trust", "h20", 1.0), ("trust", "h0", 0.5), ("distrust", "h14", 1.0), ("distrust", "h55", 0.25)]
    arcs = url_filter.arcs_of(spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "source string, target string, n long")).cache()
    got = {(r.kind, r.host): r.score for r in url_filter.propagate(arcs, spark.createDataFrame(seeds, "kind string, host string, score double"), tolerance=1e-6).collect()}
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((60, 60))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    for kind, m in (("trust", w), ("distrust", w.T)):
        share = m / np.maximum(m.sum(1, keepdims=True), 1)
        s = np.zeros(60)
        for k, h, x in seeds:
            s[at[h]] += 0.15 * x * (k == kind)
        want = np.linalg.solve(np.eye(60) - 0.85 * share.T, s)
        assert all(got.get((kind, h), 0.0) == pytest.approx(want[at[h]], abs=2e-5) for h in hosts)
        assert {h for k, h in got if k == kind} == {h for h in hosts if want[at[h]] > 0}
    assert got["distrust", "h0"] > 0
    with pytest.raises(RuntimeError):
        url_filter.propagate(arcs, spark.createDataFrame(seeds, "kind string, host string, score double"), most_rounds=2)


def test_url_filter_sql_of_linked_pages(spark):
    import duckdb

    rng = np.random.default_rng(13)
    hosts = [f"{'ab'[i % 2]}{i}.{'org' if i % 5 == 0 else 'net' if i % 5 == 1 else 'x'}" for i in range(30)]
    pages = [(n, f"http://{h}/{['es', 'de', 'fr'][n % 3]}/{n}", "".join(f'<a href="//{hosts[int(j)]}/x">' for j in rng.integers(0, 30, 3))) for n in range(120) for h in [hosts[int(rng.integers(0, 30)) if n % 3 else 0]]]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.op1_sql()})").fetchall(), key=str)
    got = sorted(map(tuple, url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), tolerance=1e-6).collect()), key=str)
    assert got == want and {r[4] for r in got if r[3] is None} == {"allow", "block"}


# ---- simhash


def slow_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if counts[i] * 2 > len(grams)) if grams else 0


def slow_components(fps, radius):
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_simhash_against_brute_force(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = [(i, slow_fingerprint(t)) for i, t in sorted(rows.items())]
    for run in (4096, 2):
        got = simhash.near_duplicates(docs, run=run).collect()
        assert len(got) == docs.count()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(fps)
        assert {r.doc_id: r.component_id for r in got} == slow_components(fps, 4)
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == set(slow_components(fps, 4).values())


def test_keep_first_takes_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{k}{i * 7 % 41}" for i in range(40)) for k in "abcd")
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (1, c), (1, d), (2, c), (0, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _row string, row int").repartition(3)
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(None, a), (None, b), (1, c), (1, d), (0, None)])


@pytest.mark.parametrize("radius", [2, 4, 6])
def test_covering(radius):
    rng = np.random.default_rng(3)
    kept = simhash.masks(radius)
    for _ in range(2000):
        flips = rng.choice(64, radius, replace=False)
        d = sum(1 << int(i) for i in flips)
        assert any(not m & d for m in kept)


@pytest.mark.parametrize("run", [8192, 3])
def test_links_of_dense_groups(spark, run):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(6):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(25):
            fps.add(x - (1 << 64) if x >> 63 else x)
            for i in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(i)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(nodes, run=run)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in simhash.links(nodes).collect())
    found = {r.node: r.component for r in components.components(edges).collect()}
    want = slow_components([(f, f & (1 << 64) - 1) for f in fps], 4)
    assert {f: found.get(f, f) for f in fps} == want


# ---- sharding


def test_sharding(spark):
    docs = odd_documents(spark)
    got = sharding.shard(docs, "doc_id", 8, buckets=4)
    rows = got.collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(no_documents(spark), "doc_id", 8).count() == 0
    ids = sharding.shard(spark.range(20000), "id", 8)
    counts = ids.groupBy("shard").count().collect()
    assert len(counts) == 8 and all(2200 < r["count"] < 2800 for r in counts)
    assert 1900 < ids.filter("grown_shard = 8").count() < 2550
    seven = {r.id: r.shard for r in sharding.shard(spark.range(2000), "id", 7).collect()}
    assert all(r.shard in (seven[r.id], 7) for r in sharding.shard(spark.range(2000), "id", 8).collect())
    alone = sharding.shard(spark.createDataFrame([(None,), (None,)], "id long"), "id", 5).collect()
    assert {r.slot for r in alone} == {0, 1} and len({r.shard for r in alone}) == 1


def test_sharding_query(spark):
    got = {r.doc_id: r for r in sharding.op4_sharding(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = r.text.encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(data) + 1, zlib.crc32(data))


# ---- packing


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    model = packing.vocabulary()
    tokenizer = Tokenizer.from_str(model)
    docs = odd_documents(spark)
    got = packing.pack_documents(docs, model=model, capacity=512).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = np.asarray(ids[at : at + 512], "<u4")
            want[(r.doc_id, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 2
    assert packing.pack_documents(no_documents(spark), model=model).count() == 0


def test_best_fit_closes_the_fullest():
    bins, offsets = packing.best_fit([60, 50, 45, 30, 40], 100, 2)
    assert bins == [0, 1, 1, 0, 2] and offsets == [0, 0, 50, 60, 0]
    bins, _ = packing.best_fit([60, 70, 80, 40], 100, 2)
    assert bins == [0, 1, 2, 0]  # the third bin closed the second, which was fuller than the first


def test_word_by_word_ids_equal_whole_ids():
    from tokenizers import Tokenizer

    model = packing.vocabulary()
    tokenizer, encode = Tokenizer.from_str(model), packing.word_encoder(model)
    texts = ["It's  A\u00a0test\x1c of <|endoftext|> odd\x85things, e\u0301 \u0301x \u03a3\u03a3 \u0130stanbul I'LL don't\n\n##@ 12 3.4", "", " ", "\u2028a\u3000b", "<| startoftext |> <|startoftext|>x"]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# ---- secrets


def slow_spans(text):
    found = []
    for order, r in enumerate(secrets.BASE + secrets.MORE):
        pattern = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(r.kind, r.pattern)
        least = {"access": 18, "hex": 16}.get(r.kind, r.least)
        for m in re.finditer(pattern, text or "", re.I | re.A if r.fold else re.A):
            if len(m[r.group]) >= least:
                found.append((m.start(), order, f"{r.kind}:{m.start()}:{m.end()}"))
    return sorted(found)


SECRETS = [
    "token=secret:abcdefghijklmnop and PASSWORD : 'abcdefghijkl' api_key=ABCDEFGHIJKLMNOP apikey='short'",
    "\U0001f600\U0001f600 passwd=\"a1b2c3d4e5f6g7\" AKIAABCDEFGHIJKLMN AKIAAKIAABCDEFGHIJ AKIA short",
    "deadbeefdeadbeef 0123456789abcdef0 DEADBEEFDEADBEEF secret=deadbeefdeadbeefdeadbeef",
    "gh" + "p_" + "A" * 40 + " xox" + "b-1234567890-abc AIza" + "b" * 35 + " -----BEGIN RSA PRIVATE KEY----- sk_" + "live_" + "a" * 20,
    "ey" + "J" + "a" * 12 + ".ey" + "J" + "b" * 12 + ".cccccc Token  =  abcdefghijklmnop",
    "tok en=abcdefghijklmnop",
    "secret:" * 50 + "abcdefghijklmnop",
    None,
    "",
]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_secrets_against_brute_force(spark, bound):
    docs = odd_documents(spark).union(spark.createDataFrame([(1000 + i, t, "", "", 0, "", "", 0, 0, None) for i, t in enumerate(SECRETS * 2)], odd_documents(spark).schema))
    got = collections.Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.found)) for r in secrets.scan(docs, broadcast_rows=bound).collect())
    want = collections.Counter((r.doc_id, ",".join(s[2] for s in slow_spans(r.text))) for r in docs.collect())
    assert got == want
    assert secrets.scan(no_documents(spark)).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_secrets_of_rows_without_an_id(spark, bound):
    rows = [(None, t) for t in [*SECRETS, "nothing here"]] + [(1, SECRETS[0]), (2, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text, ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.found)) for r in secrets.scan(docs, broadcast_rows=bound).collect())
    assert got == collections.Counter((i, t, ",".join(s[2] for s in slow_spans(t))) for i, t in rows)
    out = [r.text for r in secrets.redact(docs).collect() if r.doc_id is None]
    assert len(out) == len(SECRETS) + 1 and SECRETS[0] not in out and SECRETS[1] not in out


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(SECRETS)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert out[0].text.count("[SECRET]") == 2 and out[7].text is None and out[5].text == SECRETS[5] and out[5].n_chars == len(SECRETS[5])
    assert out[2].text == "[SECRET] [SECRET] DEADBEEFDEADBEEF [SECRET]" and out[2].n_chars == len(out[2].text)
    assert all(not slow_spans(r.text) for r in out.values() if r.doc_id != 6)


def test_secrets_query(spark):
    got = {r.doc_id: r for r in secrets.op9_secrets(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = slow_spans(r.text)
        base = ",".join(s[2] for s in spans if s[1] < 3)
        x = got[r.doc_id]
        assert (x.base_sha256, x.spans) == (hashlib.sha256(base.encode()).hexdigest(), ",".join(s[2] for s in spans))
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == i for s in spans) for i in range(3)]


def test_trigram_queries():
    query = secrets.trigram_query
    assert query("[0-9a-f]+") is None and query("a.c") is None and query("(x|abc)d") is None
    assert query("abcd") == ("and", ("abc", "bcd")) and query("ab?cde") == ("or", (("and", ("abc", "bcd", "cde")), ("and", ("acd", "cde"))))
    assert query("(foo|bar)+") == ("or", ("bar", "foo"))


# ---- merges, clashing names


def test_merges_of_many_words_are_the_librarys():
    from tokenizers import Tokenizer

    model = packing.vocabulary()
    tokenizer, merges = Tokenizer.from_str(model), packing.Merges(model)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlucmfwypvbgkqjxzéßñà"), rng.integers(1, 40))) for _ in range(3000)] + ["a", "aaaaaaaaaa", "banana" * 9, "é"]
    got = merges.encode([w.encode() for w in words])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert merges.encode([]) == []


def test_packing_is_online_and_near_the_floor(spark):
    rng = np.random.default_rng(6)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.1, 16384).astype(int) + 1).tolist()
    bins, _ = packing.best_fit(lengths, 4096, packing.OPEN_BINS)
    assert max(bins) + 1 <= -(-sum(lengths) // 4096) * 1.005
    rows = [(None, 0, 0, n, "g", 1, 2) for n in lengths[:3000]]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, _group string, _TURN int, offset long").repartition(3)
    got = packing.pack(found, group_rows=500)
    assert got.columns == ["doc_id", "piece", "start", "length", "_group", "_TURN", "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(r.length for r in rows) == sorted(lengths[:3000]) and {(r["_group"], r["_TURN"]) for r in rows} == {("g", 1)}
    sizes = collections.Counter(r.sequence_id >> 32 for r in rows)
    assert len(sizes) == 6 and max(sizes.values()) < 700  # rows without an id are dealt out like others
    ends = collections.defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 4096 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] for b in ends.values())


def test_jump_hash_is_the_published_walk(spark):
    import struct

    def walk(key, shards):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        at, to, i = 0, 0, 0
        while to < shards:
            drawn = (xxhash.xxh64(struct.pack("<i", i), seed=seed).intdigest() >> 33) + 1
            at, to, i = to, int((to + 1) * float(1 << 31) / drawn), i + 1
        return at

    keys = [None, 0, 1, -1, 2**62, *range(500, 900)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 8, 9, 40):
        assert [r.s for r in rows.select(sharding.jump_hash(rows.k, shards).alias("s")).collect()] == [walk(k, shards) for k in keys]


def test_sharding_splits_a_hot_key_and_keeps_columns(spark):
    rows = spark.createDataFrame([(7, i, "s", "r") for i in range(300)] + [(None, i, "s", "r") for i in range(50)], "k long, _shard long, _RANK string, _bucket string").repartition(3)
    got = sharding.shard(rows, "k", 4, buckets=16)
    assert got.columns == ["k", "_shard", "_RANK", "_bucket", "shard", "slot", "grown_shard"]
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r.shard].append(r.slot)
        assert (r["_RANK"], r["_bucket"]) == ("s", "r")
    assert all(sorted(x) == list(range(len(x))) for x in found.values()) and sum(map(len, found.values())) == 350
    assert sorted(r._shard for r in got.collect()) == sorted([*range(300), *range(50)])


def test_secrets_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(None, SECRETS[0], 1, "f", "o"), (3, SECRETS[1], 2, "f", "o"), (3, SECRETS[1], 2, "f", "o")], "doc_id long, text string, rules long, _found string, _of string").repartition(2)
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.rules, r._found, r._of) for r in rows) == [(1, "f", "o"), (2, "f", "o"), (2, "f", "o")]
    assert all("[SECRET]" in r.text for r in rows)
    assert secrets.scan(docs).columns == [*docs.columns, "found"]
    assert secrets.redact(docs.limit(0)).count() == 0


def test_secrets_sql(spark):
    import duckdb

    rows = [(i, t) for i, t in enumerate([*SECRETS, "a" * 50, "\U0001f600 é " + SECRETS[1]])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(secrets.op9_sql()).fetchall()
    assert len(found) == len(rows)
    for doc_id, *counts, digest, spans in found:
        want = slow_spans(rows[doc_id][1])
        assert spans == ",".join(s[2] for s in want) and counts == [sum(s[1] == i for s in want) for i in range(3)]
        assert digest == hashlib.sha256(",".join(s[2] for s in want if s[1] < 3).encode()).hexdigest()
