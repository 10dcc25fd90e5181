"""Spelling groups, collocations and best-fit packing against brute force and SQL, with odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trafficlens.llm import bestfit, collocation, spelling
from trafficlens.llm.registry import oracle_sql

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, word string, n long, key string, length long, rank long, piece int"


def frame(spark, rows):
    """Rows (doc_id, text, lang) with further columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, lang, "clash", 1, "clash", 2, 3, 4) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Few letters and few words, so that neighbours, ties and frequent phrases are many; nulls, odd texts, repeats and a long text."""
    rng = random.Random(11)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "the", "ab", "new", "york"]

    def text(n):
        return "".join(rng.choice(stems[: rng.choice([4, 46])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " The ", "-"]) for _ in range(n))

    out = [(k, text(rng.choice([0, 1, 5, 60])), rng.choice(["en", "fr", None, "und"])) for k in range(150)]
    out += [(500, None, "en"), (501, "", None), (502, " \n ", "en"), (503, "×÷ ßÀÿ ĀĂ日本 aaaaaaĀaaaaaa $aaaaaa$", "en"), (504, text(6000), "en"), (None, "aaaaaa aaaaaa", "en")]
    return out + out[:3] + [out[-1], (505, "New YORK " * 40, "fr"), (507, "library " * 150 + "librery " * 30 + "libbrery " * 6 + "librarz librarx " * 7 + "Los Angeles times. " * 40, "fr"), (506, "a.b:c;d!e?f\x0bg\x0ch\ri" * 3, "fr")]


def brute_words(rows):
    n = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 5}


def brute_groups(rows):
    words = brute_words(rows)
    alphabet = sorted({c for w in words for c in w})
    near = {w: {x for i in range(len(w) + 1) for x in [w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in alphabet), *(w[:i] + c + w[i:] for c in alphabet)] if x in words and x != w} for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def groups_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_spelling_against_brute_force(spark, rows):
    got, want = groups_of(spelling.spelling_groups(frame(spark, rows))), brute_groups(rows)
    assert got == want
    assert ("libbrery", "librery", "library", 6, 1, 30) in want and any(n > 2 for *_, n, _ in want)


def test_spelling_when_tasks_hand_on_early(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    assert groups_of(spelling.spelling_groups(frame(spark, rows).repartition(7))) == brute_groups(rows)


def test_neighbours_of_runs_of_one_character(spark):
    words = [("aaaaaa", 9), ("aaaaaaa", 9), ("aaaaaaaa", 9), ("aabaaa", 1), ("aaaaab", 9), ("baaaaa", 9), ("", 5)]
    got = {r["word"]: (r["n_near"], r["best"]["word"], -r["best"]["minus"]) for r in spelling.neighbours(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"aaaaaa": (4, "aaaaaaa", 9), "aaaaaaa": (2, "aaaaaa", 9), "aaaaaaaa": (1, "aaaaaaa", 9), "aabaaa": (1, "aaaaaa", 9), "aaaaab": (1, "aaaaaa", 9), "baaaaa": (1, "aaaaaa", 9)}


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 12])
def test_roots_of_long_ways(spark, steps):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(steps)], "word string, form string")
    assert {r["root"] for r in spelling.follow_forms(forms, 5 * 5**steps).collect()} == {f"w{steps}"}


def brute_phrases(rows, least=30, top=2000):
    f = defaultdict(Counter)
    for _, t, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        longer = Counter()
        for p, a in c.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and 100 * longer[p] < 80 * a:
                s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], sum(v for x, v in c.items() if len(x) == 1), s))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(found)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrases_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_collocations_against_brute_force(spark, rows):
    want = brute_phrases(rows)
    assert phrases_of(collocation.collocations(frame(spark, rows))) == want
    assert len({len(r[2].split(" ")) for r in want}) == 3


def test_collocations_in_many_ranges_and_small_blocks(spark, rows, monkeypatch):
    for name, value in {"RANGE_BYTES": 1 << 12, "BLOCK_BYTES": 1 << 10, "HELD_PHRASES": 300, "HELD_WORDS": 30, "GROUP_PARTS": 7}.items():
        monkeypatch.setattr(collocation, name, value)
    docs = frame(spark, rows).repartition(5)
    assert phrases_of(collocation.collocations(docs, least=4, top=60)) == brute_phrases(rows, 4, 60)
    _, route = collocation.frequent_phrases(docs, 3, 4)
    assert route.bits > 3 and len(route.hot[1])


def test_large_counts_stay_exact(spark):
    wide = 3_000_000_000_000_000_000
    row = spark.createDataFrame([(wide, wide, wide)], "a long, l1 long, r1 long")
    assert row.selectExpr("(2000000 * cast(a as decimal(20,0))) div (cast(l1 as decimal(20,0)) + cast(r1 as decimal(20,0))) as s").first()["s"] == 1_000_000


def test_equal_codes_are_noticed(spark):
    words = ["one", "two"]
    rows = [collocation._row("en", 0, 0, np.array([7], np.uint64), [w.encode()], [np.array([0])], np.array([40])) for w in words]
    shards = spark.createDataFrame(collocation._batch(rows).to_pylist(), collocation.AUTOMATON)
    with pytest.raises(Exception, match="have one code"):
        collocation._union(shards, 30).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_automata_hold_their_phrases(n):
    rng = random.Random(n)
    paths = sorted({tuple(rng.randrange(5) for _ in range(n)) for _ in range(80)})
    columns = [np.array(c) for c in zip(*paths, strict=True)]
    sizes, arcs, ends = collocation.build(columns)
    assert sizes[-1] == len(paths) and sizes[0] <= 5
    assert [c.tolist() for c in collocation.unfold(sizes, arcs, ends)] == [c.tolist() for c in columns]


@pytest.mark.parametrize("name", ["op11_spelling", "op12_collocations"])
def test_sql_says_the_same(spark, rows, name):
    own = [r for r in rows if r[0] is not None]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    c.executemany("insert into documents values (?, ?, ?)", own)
    cur = c.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = spelling.spelling_groups(frame(spark, own)) if name == "op11_spelling" else collocation.collocations(frame(spark, own))
    assert sorted(names) == sorted(df.columns)
    text = lambda r: tuple(map(str, r))
    assert sorted(text(r[c] for c in names) for r in df.collect()) == sorted(map(text, cur.fetchall()))


def test_no_rows(spark):
    for docs in (frame(spark, []), frame(spark, [(1, None, None), (2, "  ", "en")])):
        assert not spelling.spelling_groups(docs).count()
        assert not collocation.collocations(docs).count()
    assert not bestfit.pack_whole(frame(spark, []), PATH).count()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_library_s_ids(library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "'s", "1", "é", "!", " ", "　", "\x1c", "\x85", "<|endoftext|>", "​", "日", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += [" ", "a ", " a", "x" * 3000 + " y", "word " * 500, "a\n b"]
    encoder = bestfit.ChunkEncoder(open(PATH, encoding="utf-8").read())
    for _ in range(2):
        got = encoder.encode(pa.array([*texts, None]))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch([*texts, ""], add_special_tokens=False)]
        encoder.old, encoder.young = encoder.young, {}  # the older generation answers next
    assert not encoder.encode(pa.array([], pa.string()))


def check_packing(df, rows, library, capacity):
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    pieces, bins = Counter(), defaultdict(list)
    for r in df.collect():
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, copies in ids.items():
        for x in copies:
            first = len(x) % capacity or capacity
            for p, (s, e) in enumerate(zip([0, *range(first, len(x), capacity)], range(first, len(x) + 1, capacity), strict=True)):
                want[i, p, s, e - s, zlib.crc32(np.array(x[s:e], "<u4").tobytes())] += 1
    assert pieces == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(k[3] * n for k, n in want.items())


def test_best_fit_packing(spark, rows, library, monkeypatch):
    many = rows + [(1000 + k, "same words here " * (k % 9), "en") for k in range(300)]
    for capacity, group in ((2048, 2000), (64, 13)):
        monkeypatch.setattr(bestfit, "GROUP_ROWS", group)
        n, tokens = check_packing(bestfit.pack_whole(frame(spark, many).repartition(5), PATH, capacity=capacity), many, library, capacity)
        assert n <= -(-tokens // capacity) * 1.06 + 1


def fewest(sizes, capacity):
    """The fewest sequences for some pieces, by trying every place for each."""
    best = len(sizes)

    def go(k, space):
        nonlocal best
        if len(space) >= best:
            return
        if k == len(sizes):
            best = len(space)
            return
        for room in {s for s in space if s >= sizes[k]} | {capacity}:
            rest = list(space)
            if room in rest:
                rest.remove(room)
            go(k + 1, [*rest, room - sizes[k]])

    go(0, [])
    return best


def test_plans_are_near_the_fewest_sequences():
    rng = random.Random(5)
    extra = 0
    for _ in range(60):
        capacity = rng.choice([9, 12, 30])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        steps = bestfit.plan_sequences(Counter(sizes), capacity)
        used = max(s[4] + -(-s[2] // s[3]) for s in steps)
        assert Counter({k: sum(s[2] for s in steps if s[0] == k) for k in set(sizes)}) == Counter(sizes)
        large = [s for s in sizes if 3 * s > capacity]
        if len(large) == len(sizes):
            assert used == fewest(sizes, capacity)  # matching of pairs leaves nothing to gain
        extra += used - fewest(sizes, capacity)
    assert extra <= 3


def test_plan_steps_follow_lengths_not_pieces():
    counts = {s: 1_000_003 + s for s in range(1, 2049)}
    steps = bestfit.plan_sequences(counts)
    total = sum(s * n for s, n in counts.items())
    assert len(steps) < 100_000 and max(s[4] + -(-s[2] // s[3]) for s in steps) <= total / 2048 * 1.001


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bestfit.ChunkEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
