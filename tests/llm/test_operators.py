import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trafficlens.llm import ann_graph, bpe, cotrain, fingerprint, maxent_lm, near_dup, packing, sharding, toxicity, url_filter
from trafficlens.llm.common import connected_components
from trafficlens.llm.registry import URL_RULES

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the of and to in is that it was for on are as with his they at be this have from".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id long"


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "x", "ing", "é", "."]) for _ in range(n))


def corpus(rng, n=120):
    """Documents with copies, near copies, nulls, empty and short texts, a long one, and a null id."""
    rows = []
    for i in range(n):
        t = text_of(rng, rng.choice([1, 3, 5, 40, 80]))
        if i % 7 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 7 == 5 and rows:
            base = (rows[rng.randrange(len(rows))][1] or "a b c").split(" ")
            base[rng.randrange(len(base))] = "edited"
            t = " ".join(base)
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, text_of(rng, 6000)), (1004, "one two"), (1005, "One TWO")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def frame(spark, rows):
    # further columns whose names clash with those of the results
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], "src", len(t or ""), "clash", 7) for k, (i, t) in enumerate(rows)], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, docs, rows, tokenizer):
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, PATH).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(empty(spark), PATH).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert len(back) == len(rows)


def test_bpe_on_odd_texts(tokenizer):
    enc = bpe.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(2)
    alphabet = "aehtinsrABC'stre  \n\t\x1c\x85\xa0éÉßΣσİç中文한🎉🏽́​.,!?-0123½²_#<|endoftext|>"
    for k in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        if k % 4 == 0:
            s = "".join(rng.choice("aehtin") for _ in range(rng.randrange(1, 60))) + rng.choice(["", "<|endoftext|>", "'ll"])
        ids = np.frombuffer(enc.encode(s), "<u4")
        assert ids.tolist() == tokenizer.encode(s, add_special_tokens=False).ids, s
        assert enc.decode(ids) == tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(pairs, nodes):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def near_by_brute_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = groups(links, ids)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_near_duplicates(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == near_by_brute_force(rows)
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t[: rng.choice([120, 118, 112])])))
    # documents that share one passage and nothing else
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == near_by_brute_force(rows)


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a), (1, b), (2, a), (2, b + " more"), (3, b.replace("b30", "x")), (4, c), (4, ""), (4, None), (5, c.upper()), (5, c), (6, ""), (6, "x"), (7, ""), (8, text_of(rng, 50)), (8, a), (9, "x"), (9, "x")]
    links = []
    for i, t in rows:
        for j, u in rows:
            x, y = near_dup._shingle_set(t or ""), near_dup._shingle_set(u or "")
            if i != j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((i, j))
    at = groups(links, {i for e in links for i in e})
    want = Counter((i, len(near_dup._shingle_set(t or "")), at.get(i, i), at.get(i, i) == i) for i, t in rows)
    docs = frame(spark, rows)
    assert Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == want
    assert sorted(r.doc_id for r in near_dup.keep_one_of_each(docs).collect()) == sorted({i for i, _ in rows if at.get(i, i) == i})


def test_one_of_each_group_stays_with_all_columns(spark, docs, rows):
    twice = docs.unionByName(docs.where("doc_id = 0")).unionByName(frame(spark, [(None, "no id"), (None, "no id")]))
    out = near_dup.keep_one_of_each(twice)
    assert out.columns == docs.columns
    want = Counter(i for i, (_, _, kept) in near_by_brute_force(rows).items() if kept) + Counter({None: 2})
    assert Counter(r.doc_id for r in out.collect()) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (None, 3)]
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups([(a, b) for a, b in edges if a is not None], nodes)


def test_fingerprints(spark, docs, rows):
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ({s for s in shingles(x.lower())} for x in (t, edited))
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i].near_edited - true) < (0.25 if len(a | b) > fingerprint.K else 1e-9)
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint.fingerprint_documents(empty(spark)).count() == 0


def test_fingerprints_of_many_stretches(spark, monkeypatch):
    docs = frame(spark, [(i * i, f"text {i} of many, as neighbours see it") for i in range(1200)] + [(0, "a second text zero")])
    want = sorted(fingerprint.fingerprint_documents(docs).collect())
    monkeypatch.setattr(fingerprint, "STRETCH_ROWS", 1)
    assert sorted(fingerprint.fingerprint_documents(docs).collect()) == want and len(want) == 1201


def test_sketches_merge_and_travel_as_text(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.shingle_sketch(F.col("a"), 8).alias("a"), fingerprint.shingle_sketch(F.col("b"), 8).alias("b"))
    r = df.select(fingerprint.merge(F.col("a"), F.col("b"), 8).alias("m"), "a", "b", fingerprint.from_text(fingerprint.to_text(F.col("a"))).alias("t"), fingerprint.containment(F.col("a"), F.col("a"), 8).alias("c")).first()
    assert r.m == sorted(set(r.a) | set(r.b))[:8] and r.t == r.a and r.c == 1.0


def test_shards_are_even_and_slots_gapless(spark, docs, rows):
    hot = frame(spark, [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)])
    for df, shards in ((docs, 4), (hot, 10)):
        out = sharding.shard_by_bytes(df, shards).collect()
        size, slots = Counter(), defaultdict(list)
        for r in out:
            size[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert len(out) == df.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in out)
    texts = dict(rows)
    for r in sharding.shard_by_bytes(docs, 4).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
    assert sharding.shard_by_bytes(empty(spark), 4).count() == 0


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(4)
    texts = [text_of(rng, 30) for _ in range(200)]
    rows = [(i, rng.choice(texts)) for i in range(1500)] + [(5000 + i, "hot") for i in range(3000)] + [(None, None), (None, ""), (1, texts[0])]
    out = sharding.shard_by_bytes(frame(spark, rows), 8).collect()
    where, size = defaultdict(set), Counter()
    for r in out:
        where[r.text_crc32].add(r.shard)
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert len(out) == len(rows) and len(where[zlib.crc32(b"hot")]) > 1
    assert all(len(s) == 1 for c, s in where.items() if c != zlib.crc32(b"hot"))
    assert max(size.values()) < 1.06 * mean and min(size.values()) > 0.94 * mean


def test_packing(spark, docs, rows, tokenizer):
    out = packing.pack_documents(docs, PATH).toPandas()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    for i, g in out.sort_values("start").groupby("doc_id"):
        assert (g["doc_tokens"] == len(ids[i])).all() and g["length"].sum() == len(ids[i])
        assert list(g["start"]) == [0, *np.cumsum(g["length"])[:-1]]
        assert list(g["ids_crc32"]) == [zlib.crc32(ids[i][s : s + n].tobytes()) for s, n in zip(g["start"], g["length"], strict=True)]
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= packing.CAPACITY
    assert out["length"].sum() > 0.5 * packing.CAPACITY * out["sequence_id"].nunique()
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_packing_of_many_short_rests(spark, tokenizer):
    rng = random.Random(12)
    rows = [(i, text_of(rng, rng.randrange(0, 90))) for i in range(4000)] + [(7, "a repeated row")] * 3 + [(None, "no id")]
    out = packing.pack_documents(frame(spark, rows), PATH).toPandas()
    assert out["length"].sum() == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= packing.CAPACITY
    assert out["length"].sum() > 0.99 * packing.CAPACITY * (out["sequence_id"].max() - 1)
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].max() + 1))


def test_cuts_are_whole_and_fit_their_class():
    for n in range(1, 3 * packing.CAPACITY, 7):
        pieces = packing.cut_lengths(n)
        assert sum(p for p, _ in pieces) == n
        assert all(packing.CAPACITY / (i + 1) < p <= packing.CAPACITY / i for p, i in pieces)


def test_urls(spark):
    data = [
        (1, "https://A.EXAMPLE.com/en/x?q#f", '<link rel="canonical" href="//m.foo.org/z">'), (2, "http://m.foo.org/z#t", None), (3, "https://www.example.com/en/k", ""), (4, "nothing", ""), (5, None, "<html>"),
        (6, "http://foo.org/go", "<META HTTP-EQUIV=\"refresh\" content=\"0; URL='http://m.foo.org/z?utm_x=1'\">"), (7, "http://net", "x"), (8, "http://x.net/es/a", "y"), (9, "http://x.net/espada", ""), (10, "http://iso.org/a/b", "<link rel=canonical href=c>"),
        (11, "http://www.example.com/en/y", '<link rel="canonical" href="http://m.foo.org/z">'),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, host string")
    want = {1: ("example.com/en/", "block"), 2: (None, "block"), 3: ("www.example.com/en/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"), 7: (None, "allow"), 8: ("net/es/", "block"), 9: (None, "allow"), 10: (None, "allow"), 11: ("www.example.com/en/", "allow")}
    for rules in (URL_RULES, URL_RULES + [("block", f"zz{i}.org/") for i in range(url_filter.INLINE_RULES)]):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
        assert got == want
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_url_rules_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from trafficlens.llm import registry

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    try:
        c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    except duckdb.Error:
        pytest.skip("no test tables")
    got = registry.op10_url_filter(spark, sf)
    want = c.execute(f"select {', '.join(got.columns)} from ({registry.oracle_sql()['op10_url_filter']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_redirects_against_brute_force(spark):
    """Random redirect graphs: a block reaches every alias that no rule allows."""
    rng = random.Random(9)
    hosts = ["a.org", "b.org", "x.net", "www.example.com", "example.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'k'])}/{i}" for i in range(150)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(90)] + [(urls[0], "http://y.net/es/outside"), (None, urls[1])]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, urls[5], None])], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES, spark.createDataFrame(links, "url string, target string")).collect()}

    def rule(u):
        host, _, path = u.partition("://")[2].partition("/")
        fit = [(len(t), v == "allow", v, t) for v, t in URL_RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and ("/" + path).startswith("/" + t.partition("/")[2])]
        return max(fit)[2:] if fit else (None, None)

    comp = groups([(a, b) for a, b in links if a], {*urls, "http://y.net/es/outside"})
    bad = {comp[u] for u in comp if rule(u)[0] == "block"}
    for i, u in enumerate([*urls, urls[5]]):
        v, t = rule(u)
        assert got[i] == (t, v or ("block" if comp[u] in bad else "allow")), u
    assert got[len(urls) + 1] == (None, "allow") and any(v == "block" and r is None for r, v in got.values())


def test_convolution_equals_a_plain_forward_pass():
    """Scores of whole batches against one window at a time."""
    import pyarrow as pa

    from trafficlens.llm.textblocks import blocks

    rng = random.Random(4)
    model = toxicity.ConvModel.fresh(np.random.default_rng(3))
    model.bias[:] = np.random.default_rng(4).normal(size=len(model.bias))
    texts = [text_of(rng, n) for n in (1, 2, 3, 50, 700)] + ["", None, " ", "one"]
    for block in blocks(pa.array(texts), 600):
        rows = toxicity.word_rows(block)
        got = model.logits(rows, block.word_offsets)
        for d in range(block.n):
            x = model.table[rows[block.word_offsets[d] : block.word_offsets[d + 1]]].sum(1)
            h = []
            for k, w in enumerate(toxicity.WIDTHS):
                seen = [sum(x[i + j] @ model.kernels[k][j] for j in range(w)) for i in range(len(x) - w + 1)]
                h.append(np.max(seen, axis=0) if seen else np.zeros(toxicity.FILTERS))
            assert abs(np.maximum(np.concatenate(h) + model.bias, 0) @ model.out + model.out_bias - got[d]) < 1e-4


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[100:140] = x[100]  # more copies than a result holds
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14)]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, score int")
    out = ann_graph.nearest(df).toPandas()
    hits = []
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        g = out[out["query_id"] == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], atol=1e-12)
        assert (np.diff(g["score"]) <= 1e-12).all()
        hits.append(len(set(want) & set(g["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9 and out["query_id"].nunique() == 45
    assert list(out[out["query_id"] == 100].sort_values("rank")["vec_id"]) == list(range(101, 121))
    assert ann_graph.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_recall_in_shards_of_configured_size(spark, lengths, monkeypatch):
    """Random directions, the hardest case, in shards far larger than the beam."""
    monkeypatch.setattr(ann_graph, "LEAST_SHARDS", 1)
    rng = np.random.default_rng(2)
    n = 7000
    x = rng.normal(size=(n, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths == "unequal":
        x *= np.exp(rng.normal(size=n) * 0.5)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann_graph.nearest(df, query_divisor=50).toPandas()
    hits = []
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20]) & set(g["vec_id"])) / 20)
    assert len(hits) == n // 50 and np.mean(hits) >= 0.95


def test_language_model(spark, docs, rows):
    got = {r.doc_id: r for r in maxent_lm.score_documents(docs, head_words=20).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in words[i])
    n, v = sum(count.values()) + len(train), len(count) + 1
    for i, w in words.items():
        base = sum(log10((c + 1) / (n + v + 1)) for c in [count[x] for x in w] + [len(train)])
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, 1 + sum(count[x] > 0 for x in w), n, i not in train)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    # words drawn at random leave nothing to learn beyond their counts
    assert sum(r.score for r in got.values()) > 1.02 * sum(r.base_score for r in got.values())
    assert maxent_lm.score_documents(empty(spark)).count() == 0


def test_model_probabilities_sum_to_one(spark):
    texts = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a", "b a b c d", "d d a"]) if zlib.crc32(str(i).encode()) % 7 != 2]
    known = sorted({w for _, t in texts for w in t.split()})
    # one-word documents: P(word) P(end | word); two-word ones give the rest
    probe = [(100 + k, w) for k, w in enumerate([*known, "unseen"])]
    held = [(i, w) for i, w in ((next(j for j in range(100 + 50 * k, 150 + 50 * k) if zlib.crc32(str(j).encode()) % 7 == 2), w) for k, (_, w) in enumerate([*probe, (0, "")]))]
    r = {x.doc_id: x.score for x in maxent_lm.score_documents(frame(spark, texts + held), head_words=2, rounds=0).collect()}
    end = 10 ** r[held[-1][0]]
    total = sum(10 ** r[i] / end for i, w in held[:-1]) + end
    assert 0.98 <= total <= 1 + 1e-6  # classes without members hold the rest


def plain_softmax(features, y, place, factor):
    """One softmax trained by a loop over single tokens: the gradients of a step are summed first."""
    weights, speed = factor.weights.astype(float), np.full(len(factor.weights), 1e-2)
    at = np.cumsum([0, *factor.sizes])
    for s in range(0, len(y), maxent_lm.STEP_TOKENS):
        grad = np.zeros_like(weights)
        for i in range(s, min(len(y), s + maxent_lm.STEP_TOKENS)):
            rows = [at[k] + int(f[i]) for k, f in enumerate(features)]
            z = sum(weights[r] for r in rows) + (0 if place is None else factor.base[place[i]])
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            for r in rows:
                grad[r] += p
        seen = np.flatnonzero(np.abs(grad).sum(1))
        speed[seen] += (grad[seen] ** 2).mean(1)
        weights[seen] -= grad[seen] * (maxent_lm.RATE / len(features) / np.sqrt(speed[seen]))[:, None]
    return weights


def test_training_follows_a_plain_softmax(monkeypatch):
    monkeypatch.setattr(maxent_lm, "STEP_TOKENS", 50)
    rng = np.random.default_rng(5)
    for width, sizes, based in ((7, (5, 3), False), (4, (6, 6), True)):
        start = maxent_lm.Factor(rng.normal(0, 0.1, (sum(sizes), width)).astype(np.float32), sizes, rng.normal(0, 1, (3, width)).astype(np.float32) if based else None)
        features = [rng.integers(0, n, 180).astype(np.uint16) for n in sizes]
        y, place = rng.integers(0, width, 180), rng.integers(0, 3, 180) if based else None
        now = start.trainable()
        now.train(features, y, place)
        want = plain_softmax(features, y, place, start)
        assert np.abs(now.weights - want).max() < 1e-3 and np.abs(want - start.weights).max() > 0.05
        chances = np.stack([now.log_chances(features, np.full(180, c), place) for c in range(width)])
        assert np.allclose(np.exp(chances).sum(0), 1, atol=1e-5)


def test_scores_do_not_follow_the_storage(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "PART_TOKENS", 500)
    rng = random.Random(9)
    rows = [(i, text_of(rng, 60)) for i in range(150)]
    one, two = ({r.doc_id: r.score for r in maxent_lm.score_documents(frame(spark, given).repartition(n), head_words=40).collect()} for given, n in ((rows, 1), (rows[::-1], 7)))
    # only the last digits of single precision follow the blocks that are scored at once
    worst = max(abs(one[i] - two[i]) / abs(one[i]) for i in one)
    assert worst < 1e-6


def labelled(rng, n=400):
    """Texts of which some hold a marker word, and some are shouted; labels for most."""
    rows, labels = [], []
    for i in range(n):
        t, toxic, poor = text_of(rng, rng.choice([20, 60])), rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(["vilest", "vilely", "vile"])
            t = " ".join(w)
        if poor:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t))
        if rng.random() < 0.9:
            labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_toxicity_and_quality(spark):
    rows, labels = labelled(random.Random(6))
    truth = {i: (q, t) for i, q, t in labels}
    docs, table = frame(spark, rows + [(9000, None), (9001, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, table).collect()}
    held = [i for i in truth if out[i].held_out]
    assert len(out) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([out[i].predicted == truth[i][1] for i in held]) > 0.9
    good = {r.doc_id: r for r in cotrain.score(docs, table).collect()}
    assert len(good) == len(rows) + 2 and np.mean([good[i].predicted == truth[i][0] for i in held]) > 0.9
    clean = toxicity.keep_clean(docs, table)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in out.items() if not r.rejected}
    kept = cotrain.keep_good(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in good.items() if r.predicted}


def test_both_views_teach_and_none_itself(spark, monkeypatch):
    rows, labels = labelled(random.Random(16), 900)
    docs, table = frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int")
    seen, asked = [], cotrain._confident

    def watched(pool, views, limits, per_round, taught):
        seen.append((set(taught), asked(pool, views, limits, per_round, taught)))
        return seen[-1][1]

    monkeypatch.setattr(cotrain, "_confident", watched)
    model = cotrain.fit(cotrain.spool(cotrain.features(docs), "f"), table, rounds=2, per_round=20)
    assert all(any(h[v, c] for h in model.handed for c in (0, 1)) for v in (0, 1))
    known = {i for i, *_ in labels if i % 2}
    for taught, found in seen:
        assert not taught & {r["doc_id"] for r in found} and not known & {r["doc_id"] for r in found}
    assert {r["doc_id"] for r in seen[0][1]} <= seen[1][0]


def test_classifiers_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, none).collect())
    assert cotrain.keep_good(docs, none).count() == docs.count()
    assert toxicity.keep_clean(empty(spark), none).count() == 0 and cotrain.keep_good(empty(spark), none).count() == 0
    assert toxicity.toxicity(empty(spark), none).count() == 0 and cotrain.score(empty(spark), none).count() == 0
