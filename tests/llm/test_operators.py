"""The corpus operators against brute force, on small tables with nulls, empty and repeated rows and clashing names."""

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
rng = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(60)]


def passage(n):
    return " ".join(rng.choice(VOCAB, n))


SHARED = " ".join(f"s{i}" for i in range(60))
LONG = passage(400)
TEXTS = [None, "", "   ", "one", passage(30) + " " + SHARED + " " + passage(20), SHARED + "\n" + passage(10), LONG, LONG, LONG.replace("w1 ", "W1 ", 1), LONG + " extra", " ".join(["la"] * 120), "Só ação  über\tα", passage(36), passage(3000)]
SCHEMA = "doc_id bigint, text string, spans string, payload string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], (None, SHARED, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_simhash(docs, empty):
    import xxhash

    from tallyspark.llm.simhash import near_duplicates

    def fp(t):
        w = (t or "").encode().translate(LOW).split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = pairs(docs)
    fps = [fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    want = sorted((d is None, d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group))
    got = near_duplicates(docs, shingle=4)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want
    assert near_duplicates(empty, shingle=4).count() == 0


@pytest.mark.parametrize("k,blocks", [(4, 5), (4, 6), (3, 4), (2, 3)])
def test_signatures_find_every_near_pair(k, blocks):
    from tallyspark.llm.simhash import variants

    masks = variants(k, blocks)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, k, replace=False))
        assert any(not flip & m for m in masks)


def test_similar_groups(spark, empty):
    from tallyspark.llm.similar import similar_groups

    base = [passage(300) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " tail word") for i, t in enumerate(base)] + [(20, base[0]), (21, None), (22, "")]
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[10 + i] == got[i] == i for i in range(6)) and got[20] == 0 and got[22] == got[21] == 21
    assert similar_groups(empty).count() == 0


def jaccard(a, b, k=5):
    cut = lambda t: {tuple(t.lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def test_similar_groups_need_the_similarity_itself(spark):
    from tallyspark.llm.similar import similar_groups

    words = iter(range(10**6))
    fresh = lambda n: " ".join(f"v{next(words)}" for _ in range(n))
    lines = [(" ".join([fresh(8)] * 20), 100), (" ".join([fresh(7)] * 60), 200)]
    rows = [line + " " + fresh(n) for line, n in lines for _ in range(4)]
    body = fresh(400).split()
    rows += [" ".join(body), " ".join([*body[:360], *fresh(40).split()]), " ".join([*body[:330], *fresh(70).split()])]
    assert max(jaccard(rows[i], rows[0]) for i in (1, 2, 3)) < 0.1 and jaccard(rows[8], rows[9]) >= 0.8 and 0.6 < jaccard(rows[8], rows[10]) < 0.8 > jaccard(rows[9], rows[10])
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert got == {i: i for i in range(11)} | {9: 8}


def test_similar_pairs_at_the_threshold_are_found(spark):
    from tallyspark.llm.similar import similar_groups

    words = iter(range(10**6))
    fresh = lambda n: [f"u{next(words)}" for _ in range(n)]
    rows = []
    for n, pairs in ((364, 300), (8, 100)):  # 360 of 450 shingles in common; 4 of 5
        for _ in range(pairs):
            own = fresh(n)
            rows += [own + fresh(45), own + fresh(45)] if n > 8 else [own, own + fresh(1)]
    rows = [" ".join(r) for r in rows]
    assert all(jaccard(rows[i], rows[i + 1]) == 0.8 for i in (0, 598, 600, 798))
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    apart = [i for i in range(0, len(rows), 2) if not got[i] == got[i + 1] == i]
    assert sum(i < 600 for i in apart) <= 6 and not any(i >= 600 for i in apart)


def removed(rows, length):
    count = collections.Counter()
    words = [(t or "").encode().split() for _, t in rows]
    for w in words:
        count.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((d is None, d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 50, "limit": 2000, "hot": 2}])
def test_substrings(docs, empty, sizes):
    from tallyspark.llm.substring import deduplicate_substrings

    plain = docs.withColumnRenamed("spans", "other")
    got = deduplicate_substrings(plain, length=35, **sizes)
    assert set(plain.columns) <= set(got.columns)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == removed(pairs(docs), 35)
    assert deduplicate_substrings(empty.select("doc_id", "text"), length=35).count() == 0
    # a column of a result's name gives way, all others pass through
    clash = docs.withColumnsRenamed({"spans": "_k1", "payload": "kept"}).selectExpr("*", "7 AS n_words", "8 AS `_c0`")
    out = deduplicate_substrings(clash, length=35)
    assert out.columns == ["doc_id", "text", "_k1", "_c0", "n_words", "n_removed", "kept"]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()) == removed(pairs(docs), 35)


@pytest.mark.parametrize("order, hot", [(2, False), (2, True), (3, False), (3, True), (4, True)])
def test_kneser_ney(spark, docs, empty, monkeypatch, order, hot):
    from tallyspark.llm import kneserney
    from tallyspark.llm.kneserney import discounts, fit, score_texts

    if hot:  # whatever a sample says
        often = np.concatenate([kneserney.tokens([b"w1 w2 la s7"], 2)[0][1][:4], [kneserney.BEGIN]])
        monkeypatch.setattr(kneserney, "frequent", lambda *_: (np.sort(often), np.sort(often[1:])))
    train = docs.where("doc_id is null or doc_id % 3 <> 0")
    split = lambda t: [0, *(t or "").encode().translate(LOW).split(), None]
    texts = [split(t) for _, t in pairs(train)]
    raw = {k: collections.Counter(tuple(w[i - k + 1 : i + 1]) for w in texts for i in range(max(1, k - 1), len(w))) for k in range(1, order + 1)}
    count = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        before = collections.Counter(g[1:] for g in raw[k + 1])
        count[k] = {g: c if g[0] == 0 else before[g] for g, c in raw[k].items()}
    of = lambda c: [sum(x == i for x in c) for i in (1, 2, 3, 4)]
    d = {k: discounts(*of(c.values())) for k, c in count.items()}
    after = collections.defaultdict(lambda: [0, 0, 0, 0])
    for k in range(2, order + 1):
        for g, c in count[k].items():
            after[g[:-1]][0] += c
            after[g[:-1]][min(c, 3)] += 1
    n, v, kinds = sum(raw[1].values()), len(raw[1]), sum(count[1].values())
    floor = sum(d[1][min(t, 3)] for t in count[1].values()) / kinds / (v + 1)

    def p(g):
        c = count[len(g)].get(g, 0)
        if len(g) == 1:
            return max(c - d[1][min(c, 3)], 0) / kinds + floor
        if g[:-1] not in after:
            return p(g[1:])
        x, own = after[g[:-1]], d[len(g)]
        return (max(c - own[min(c, 3)], 0) + sum(own[i] * x[i] for i in (1, 2, 3)) * p(g[1:])) / x[0]

    want = []
    for i, t in pairs(docs):
        w = split(t)
        known = [raw[1][x,] for x in w[1:]]
        score = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(1, len(w)))
        want.append((i is None, i, len(known), sum(c > 0 for c in known), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in known), score))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in score_texts(docs, fit(train, order=order), ["doc_id"]).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    for context in ((0,), (b"w1",), (b"w2", b"w1"), (0, b"w3"))[: 2 if order == 2 else 4]:
        assert sum(p((*context, *w)) for w in raw[1]) + p((*context, b"never seen")) == pytest.approx(1)
    assert {r["score"] for r in score_texts(docs, fit(empty, order=order), ["doc_id"]).collect()} == {0.0}


@pytest.mark.parametrize("wide, rows", [(True, 5000), (False, 5000), (False, 0)])
def test_model_tables_return_what_was_put(tmp_path, wide, rows):
    from tallyspark.llm.kneserney import Table

    key = rng.choice(1 << 62, rows, replace=False).astype(np.uint64) << np.uint64(1)
    if wide:
        key[:900] = (key[0] >> np.uint64(32) << np.uint64(32)) + (np.arange(900, dtype=np.uint64) << np.uint64(17))  # equal upper halves
    for columns in (1, 2, 4):
        values = rng.zipf(1.3, (columns, rows)).astype(np.int64) % (1 << 40)
        Table.write(f"file://{tmp_path}/t{columns}", key, *values, wide=wide)
        asked = np.sort(np.concatenate([key, rng.integers(0, 1 << 62, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        hit, got = Table(f"file://{tmp_path}/t{columns}").find(asked)
        put = dict(zip(key.tolist(), values.T.tolist()))
        assert hit.tolist() == [k in put for k in asked.tolist()]
        assert got.T.tolist() == [put[k] for k in asked[hit].tolist()]


def test_language_id(spark, docs, empty):
    from tallyspark.llm.langid import identify, train

    a, b = [f"{x}ing" for x in VOCAB], [f"{x}eaux" for x in VOCAB]
    say = lambda v, n: " ".join(rng.choice(v, n))
    rows = [(i, say(a if i % 2 else b, 60), "en" if i % 2 else "fr") for i in range(60)] + [(99, say(a, 30), None)]
    model = train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    mixed = say(a, 20) + " " + say(b, 30)
    tests = spark.createDataFrame([(1, say(a, 9)), (2, say(b, 9)), (3, mixed), (4, None), (5, "12 34 …"), (6, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in identify(tests, model, ["doc_id"], segments=True).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "fr", "fr", "und", "und", "und"]
    assert [(s["lang"], s["words"]) for s in got[3]["segments"]] == [("en", 20), ("fr", 30)]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = identify(docs, train(empty.withColumnRenamed("spans", "lang")), ["doc_id"])
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


@pytest.mark.parametrize("span", [1, 2, 3, 128])
def test_forward_backward_equals_enumeration(span):
    import itertools

    from tallyspark.llm.langid import forward_backward, pair_posteriors

    emit, trans, bounds = rng.random((12, 3)), rng.random((3, 3)), [0, 4, 4, 11, 12]
    got, alpha, beta = forward_backward(emit, np.array(bounds), trans, span)
    for s, e in zip(bounds, bounds[1:]):
        mass, pair = np.zeros((e - s, 3)), np.zeros((e - s, 3, 3))
        for path in itertools.product(range(3), repeat=e - s):
            p = np.prod([emit[s + i, y] for i, y in enumerate(path)]) * np.prod([trans[x, y] for x, y in zip(path, path[1:])])
            for i, y in enumerate(path):
                mass[i, y] += p
                if i:
                    pair[i, path[i - 1], y] += p
        if e > s:
            assert np.allclose(got[s:e], mass / mass.sum(axis=1, keepdims=True))
        if e > s + 1:
            assert np.allclose(pair_posteriors(emit, trans, alpha, beta, np.arange(s + 1, e)), pair[1:] / pair[1:].sum(axis=(1, 2), keepdims=True))


def test_forward_backward_over_a_long_text():
    from tallyspark.llm.langid import forward_backward

    emit, trans = rng.random((20_000, 4)) ** 9 + 1e-6, rng.random((4, 4))
    got = forward_backward(emit, np.array([0, 19_000, 20_000]), trans)
    for a, b in zip(got, forward_backward(emit, np.array([0, 19_000, 20_000]), trans, 20_000)):
        assert np.allclose(a, b)


def test_warc(spark):
    from tallyspark.llm.common import save
    from tallyspark.llm.warc import archive_folder, frames, read_archives, write_archives

    rows = [(3, "http://a/\n", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (7, "u", "x" * 200_000), (1, None, "<p>é</p>"), (None, "u", "alone"), (9, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = save(write_archives(pages, archive_folder(spark), sample_bytes=1000), "manifest")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_archives(manifest).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in rows:
        least = min((j for j, _, u in rows if (u or "") == (t or "") and j is not None), default=None)
        want.append((i or 0, len((t or "").encode()), sha(t), *(("response", None) if i == least else ("revisit", least))))
    assert got == sorted(want)
    assert sum(len(list(frames(r["path"]))) for r in manifest.collect()) == len(rows)
    assert save(write_archives(pages.limit(0), archive_folder(spark)), "none").count() == 0
    small = save(write_archives(pages, archive_folder(spark), least=10**6), "least")
    assert {r["record_type"] for r in read_archives(small).collect()} == {"response"}


def test_ann(spark):
    from pyspark.sql import functions as F

    from tallyspark.llm.ann import nearest

    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest(table, F.col("vec_id") % 10 == 0, k=20, slice_rows=256, block_rows=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 10):
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert len(got[q]) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in got[q])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
        hits += len({i for i, _ in got[q]} & set(want))
    assert set(got) == set(range(0, 600, 10)) and hits / (60 * 20) >= 0.9
    few = nearest(table.where("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert nearest(table.where("vec_id >= 1000 and vec_id < 1004"), F.lit(True)).count() == 0


@pytest.mark.parametrize("turns", [1, 4])
def test_multi_index_finds_all_within_radius(turns):
    from tallyspark.llm.ann import MultiIndex

    codes = rng.integers(0, 2**64, (400, turns), dtype=np.uint64)
    codes[200:] = codes[:200] ^ (np.uint64(1) << rng.integers(0, 64, (200, turns), dtype=np.uint64))
    index = MultiIndex(codes)
    assert index.retrieved(codes[0], 2) is not None  # probes, and does not read through the slice
    for radius in (0, 3, 5, 21, 28, 100):
        q, r = index.search(codes[:20], np.full(20, radius))
        want = {(i, j) for i in range(20) for j in range(400) if sum(int(x).bit_count() for x in codes[i] ^ codes[j]) <= radius}
        assert len(q) == len(want) and set(zip(q.tolist(), r.tolist())) == want


def test_ann_recall_over_all_queries(spark):
    """The share of true neighbours found, and of rows that are reranked, over every query of a near-isotropic table."""
    from pyspark.sql import functions as F

    from tallyspark.llm.ann import nearest

    x = np.random.default_rng(3).normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nearest(table, F.col("vec_id") % 20 == 0, k=20, slice_rows=2048, block_rows=100).collect():
        got[r["query_id"]].add(r["vec_id"])
    score = x[::20] @ x.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -9
    want = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(got[20 * i] & set(w.tolist())) for i, w in enumerate(want)) / 6000 >= 0.9


def test_ann_rows_of_one_id(spark):
    from pyspark.sql import functions as F

    from tallyspark.llm.ann import nearest

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [-1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=9).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got) == [(0, 1, 1, 0.6), (0, 1, 1, 0.8), (0, 2, 0, 0.0), (0, 2, 0, 0.0), (0, 3, 2, -1.0), (0, 3, 2, 0.0)]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_url_rules(spark, chunk):
    from tallyspark.llm.queries import URL_RULES
    from tallyspark.llm.urlfilter import filter_urls

    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://badexample.com/en/", "http://a.b.net/es/1", "http://net/fr/", "http://x.org#/en/", "http://example.com", "http://m.example.com/en/://net/es/", "http://com/", "http://.com/x", "http://com\x01x/", "http://a\x02.com/y", "http://\x01.example.com/en/"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[3]])], "page_id bigint, url string")

    def judge(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h), len(p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = filter_urls(table, spark.createDataFrame(URL_RULES, "action string, host string, path string"), chunk=chunk)
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == [(i, *judge(u)) for i, u in enumerate([*urls, urls[3]])]


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    from tallyspark.llm.packing import pack, padding
    from tallyspark.llm.queries import tokenizer

    path = tokenizer("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(50, "It's <|endoftext|> don't é\u00a0x İŞ ΣΑΣ 12,5 a\u0301 <b>"), (51, "one\vtwo\fthree\u2028four")], "doc_id bigint, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    got = [r.asDict() for r in pack(table, path, capacity=512, classes=64).collect()]
    count = collections.Counter(pairs(table))
    for (d, t), n in count.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d and r["doc_tokens"] == len(ids))
        want = sorted((s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for s in range(0, len(ids), 512)) * n
        assert own == sorted(want) or len({x for x, y in pairs(table) if x == d}) > 1
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert padding(np.array([512, 256, 500, 3]), 512) == 12 + 509
    assert pack(empty, path).count() == 0


def test_patterns_meet_demand():
    from tallyspark.llm.packing import solve_patterns

    size, demand = np.arange(1, 33), rng.integers(1, 400, 32)
    made = solve_patterns(size, demand, 32)
    assert (sum(p * n for p, n in made) == demand).all() and all((p * size).sum() <= 32 for p, _ in made)
    # a lower bound: pieces of over half need a sequence each, and those from a up to half fill what these leave
    least = (size * demand).sum() / 32
    for a in range(1, 17):
        big, mid, low = size > 32 - a, (size > 16) & (size <= 32 - a), (size >= a) & (size <= 16)
        room = (demand * (32 - size))[mid].sum()
        least = max(least, demand[big | mid].sum() + max(0, (size * demand)[low].sum() - room) / 32)
    assert sum(n for _, n in made) <= 1.03 * least + 2


def test_decontamination(spark, docs, empty):
    import re

    from tallyspark.llm.decontaminate import decontaminate

    rx, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    items = spark.createDataFrame([(1, SHARED), (2, " ".join(SHARED.split()[5:20])), (3, "la LA la"), (4, None), (5, ""), (6, "über α"), (7, "never seen words here"), (1, SHARED), (10, "w1")], "item_id bigint, text string")
    tokens = lambda t: rx.findall((t or "").translate(low))
    windows = collections.defaultdict(set)
    for i, t in pairs(items.withColumnRenamed("item_id", "doc_id")):
        w = tokens(t)
        for a in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows[tuple(w[a : a + min(10, len(w))])].add(str(i))
    want = []
    for d, t in pairs(docs):
        w, hit, ids = tokens(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids |= windows[tuple(w[a : a + n])]
        want.append((d is None, d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = decontaminate(docs, items)[0].collect()
    assert sorted((r["doc_id"] is None, *(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))) for r in got) == sorted(want)
    assert decontaminate(empty, items)[0].count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, items.limit(0))[0].collect())


def test_quality(spark, docs, empty):
    from pyspark.sql import functions as F

    from tallyspark.llm.quality import classify

    bad = [f"vile{i}" for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, passage(60) + (" " + " ".join(rng.choice(bad, 4)) if toxic else ""), f"h{i % 4}", f"p{i % 2}"))
        if i % 2 == 0:
            labels.append((i, int(i % 6 != 0), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    tags = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(table, tags, F.col("host"), F.col("path")).collect()}
    assert all((got[i]["toxic_score"] >= 0.5) == (i % 8 == 0) for i in range(400))
    assert all(0 <= r["quality_score"] <= 1 for r in got.values())
    none = classify(docs, tags.limit(0), F.lit(None), F.col("spans")).collect()
    assert len(none) == docs.count() and all(abs(r["toxic_score"] - 0.5) < 1e-6 for r in none)
    assert classify(empty, tags, F.col("spans"), F.col("spans")).count() == 0


def test_quality_posteriors_equal_brute_force(spark):
    """Shrinkage of paths to their host and of hosts to the whole, with strengths by the method of moments."""
    from tallyspark.llm.quality import posteriors, strength

    own = np.random.default_rng(8)
    rows = [(f"h{h}" if h else None, f"p{own.integers(3)}", int(own.integers(2)) if own.random() < 0.3 else None, float(own.random() * (h + 1) / 5)) for h in range(4) for _ in range(3 + 9 * h)]
    got = posteriors(spark.createDataFrame(rows, "host string, path string, quality_label int, quality_p double"), "quality")
    evidence = [float(label) if label is not None else p for _, _, label, p in rows]
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for (host, path, _, _), e in zip(rows, evidence):
        paths[host, path].append(e)
        hosts[host].append(e)
    mean = (sum(evidence) + 0.5) / (len(evidence) + 1)

    def moments(groups):  # (n, rate, mean)
        groups = [g for g in groups if g[0] > 1]
        n = sum(g[0] for g in groups)
        between = max(0.0, (sum(k * (r - m) ** 2 for k, r, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / n)
        return min(1e4, max(1.0, sum(k * m * (1 - m) for k, _, m in groups) / n / between - 1)) if between else 1e4

    k_host = moments([(len(v), sum(v) / len(v), mean) for v in hosts.values()])
    host_mean = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = moments([(len(v), sum(v) / len(v), host_mean[h]) for (h, _), v in paths.items()])
    found = {(r["_host"], r["_path"]): r for r in got.collect()}
    assert set(found) == set(paths)
    for key, v in paths.items():
        r = found[key]
        assert r["quality_n"] == len(v) and math.isclose(r["quality_s"], sum(v)) and math.isclose(r["quality_prior"], host_mean[key[0]])
        assert math.isclose(r["quality_k"], k_path) and math.isclose(r["quality_mean"], mean)
    alike = spark.createDataFrame([(5, 2.5), (5, 2.5)], "n int, s double")
    from pyspark.sql import functions as F

    assert strength(alike, F.lit(0.5)) == 1e4 and strength(alike.limit(0), F.lit(0.5)) == 1e4


def test_one_very_long_text(spark):
    """A document of 4 MB beside short ones, through the operators that read whole texts."""
    from tallyspark.llm.decontaminate import decontaminate
    from tallyspark.llm.langid import identify, train
    from tallyspark.llm.simhash import near_duplicates
    from tallyspark.llm.substring import deduplicate_substrings

    words = [f"w{i}" for i in np.random.default_rng(4).integers(0, 50_000, 600_000)]
    long = " ".join([*words, *SHARED.split()])
    table = spark.createDataFrame([(1, long, "a"), (2, SHARED, "b"), (3, long, "a")], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(table, shingle=4).collect()} == {1: 1, 2: 2, 3: 1}
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in deduplicate_substrings(table.where("doc_id < 3"), length=35).collect()}
    assert cut == {1: (600_060, 60), 2: (60, 60)}
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate(table, spark.createDataFrame([(1, SHARED)], "item_id bigint, text string"))[0].collect()}
    assert hit == {1: 60, 2: 60, 3: 60}
    assert {r["doc_id"]: r["lang_pred"] for r in identify(table, train(table), ["doc_id"]).collect()} == {1: "a", 2: "b", 3: "a"}


def test_components(spark):
    from tallyspark.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100 and got[201] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest_keeps_components():
    from tallyspark.llm.components import forest

    for n, m in ((30, 10), (30, 60), (200, 150), (1, 1)):
        a, b = rng.integers(0, n, m).astype(np.uint64), rng.integers(0, n, m).astype(np.uint64)
        of = {int(x): int(x) for x in [*a, *b]}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist()):
                of[x] = of[y] = min(of[x], of[y])
        node, root = forest(a, b)
        assert {x: r for x, r in of.items() if x != r} == dict(zip(node.tolist(), root.tolist()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    clean = [(i, passage(200), "en", "s", 1) for i in range(12)]
    repeat = " ".join(f"r{i}" for i in range(70))
    item = " ".join(f"b{i}" for i in range(20))
    rows = [*clean, (20, clean[0][1], "en", "s", 1), (21, clean[1][1] + " more", "en", "s", 1), (22, passage(80) + " " + repeat, "en", "s", 1), (23, repeat + " " + passage(90), "en", "s", 1), (24, passage(50) + " " + item, "en", "s", 1), (25, None, "en", "s", 1), (26, "12 !", "en", "s", 1), (None, passage(150), "en", "s", 1), clean[2]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        docs = spark.read.parquet(str(tmp_path / "documents.parquet")) if not k else spark.read.parquet(str(tmp_path / f"{k}"))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k + 1}"))
        seen[name] = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / f"{k + 1}")).collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {25, 26}
    assert set(seen["near_duplicates"]) == {r[0] for r in rows} - {20, 21, 25, 26}
    cut = seen["substring_dedup"]
    assert "r5" not in cut[22] and "r5" not in cut[23] and cut[3] == clean[3][1]
    assert set(seen["decontamination"]) == set(cut) - {24}
    packed = cp.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(seen["decontamination"])


def test_stages_pass_any_further_column(spark, tmp_path):
    import corpus_pipeline as cp

    clean = [passage(120) for _ in range(6)]
    repeat = " ".join(f"q{i}" for i in range(60))
    texts = [*clean, clean[0] + " more", passage(70) + " " + repeat, repeat + " " + passage(70)]
    own = ["n_words", "n_removed", "kept", "spans", "_k1", "_k2", "score", "lang_pred", "_text", "k", "id", "n", "_c1"]
    rows = [(i, t, "en", *(f"{c}{i}" for c in own)) for i, t in enumerate(texts)]
    spark.createDataFrame([(1, "none of these")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *own])
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert docs.columns == ["doc_id", "text", "lang", *own]
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == set(range(9)) - {6} and "q5" not in got[7]["text"]
    assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in own)


def test_language_model_fails_where_a_file_cannot_be_read(docs):
    import glob
    import os

    from tallyspark.llm.common import local_path
    from tallyspark.llm.kneserney import fit

    model = fit(docs)
    text = [LONG.encode()]
    model.score(text)
    for kind in ("gram2", "ctx2", "gram3", "ctx3", "uni"):
        model._files.clear()
        files = glob.glob(f"{local_path(model.folder)}/{kind}-*")
        for f in files:
            os.rename(f, f + ".away")
        with pytest.raises(OSError):
            model.score(text)
        for f in files:
            os.rename(f + ".away", f)
