"""Phrases whose words occur together more often than their parts, by weighted acyclic automata.

A word is a 64-bit code; an automaton is a prefix tree over codes, kept level by level (labels of the arcs of a level, and where each
arc's children end in the next), whose last arcs carry counts. For phrases of 1, 2, 3 and 4 words in turn:

1. Shards: each task reads whole texts block by block, sorts the block's phrases and adds them to the phrases it holds; now and then
   and at its end it builds an automaton of these counts for each range of prefixes. A phrase of n words can be frequent only if both
   phrases of n - 1 words in it are: those found so far are a bitmap of fixed size, which may let others pass but never stops one.
2. Union: automata of one range come together, and their weights are summed. Frequent phrases go on as one automaton for each range.
   A range is one of the hash of a phrase's first n - 1 words. Prefixes that hold more than one range's share of all words are at most
   as many as there are ranges; for them the hash is of the whole phrase, so that a common first word is spread over all ranges.
3. Parts: phrases that a longer one explains are dropped, and every part of the others is sent to its range and followed there through
   the automaton. Ranges that are asked for often are asked in several groups.

Codes of different words are compared where words are counted; should two ever be equal, the job stops and says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_worker, spool
from .textblocks import mix

LONGEST, LEAST, TOP = 4, 30, 2_000
#: A longer phrase explains a part of it that occurs at most 100 / EXPLAINED times as often.
EXPLAINED = 80
SCALE = 2_000_000
#: Bits of the filter of frequent phrases: 8 MB, whatever their number.
FILTER_BITS = 1 << 26
#: Bytes of text that one range stands for, and the most ranges.
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 20
#: Bytes of text taken at once; different phrases, and words, that a task holds before it hands on automata.
BLOCK_BYTES, HELD_PHRASES, HELD_WORDS = 2 << 20, 2_000_000, 600_000
#: Parts that one group looks up.
GROUP_PARTS = 50_000
ID_BITS = 21  # of a word's number within a task: HELD_WORDS and the words of one block are fewer

_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_STOP = b"."
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

AUTOMATON = "lang string, range long, total long, codes array<long>, words array<string>, sizes array<int>, arcs array<int>, ends array<int>, weights array<long>"


def word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_hash(lang: str, codes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each phrase; codes: its first words, second words and so on."""
    h = np.full(len(codes[0]), xxhash.xxh64_intdigest(lang.encode(), len(codes)), np.uint64)
    for c, odd in zip(codes, _ODD, strict=False):
        h = mix(h + c * odd)
    return h


def build(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, arcs, ends) of the automaton of sorted different phrases, given as columns of labels."""
    m = len(columns[0])
    if not m:
        return np.zeros(len(columns), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    new = np.zeros(m, bool)
    new[0] = True
    at = []
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
        at.append(np.flatnonzero(new))
    arcs = [c[a] for c, a in zip(columns, at, strict=True)]
    ends = [np.searchsorted(deeper, np.append(a[1:], m)) for a, deeper in zip(at, at[1:], strict=False)]
    join = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return np.array([len(a) for a in at], np.int32), join(arcs), join(ends)


def unfold(sizes: np.ndarray, arcs: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The columns of labels that build() was given."""
    levels, until = np.split(arcs, np.cumsum(sizes)[:-1]), np.split(ends, np.cumsum(sizes)[:-2]) if len(sizes) > 1 else []
    out = [levels[-1]]
    below = np.ones(len(levels[-1]), np.int64)  # paths through each arc
    for labels, end in zip(levels[-2::-1], until[::-1], strict=True):
        sums = np.concatenate(([0], np.cumsum(below)))
        below = np.diff(sums[np.concatenate(([0], end))])
        out.append(np.repeat(labels, below))
    return out[::-1]


class Routes:
    """Which range a phrase belongs to. hot: for n words, sorted hashes of the prefixes that are spread."""

    def __init__(self, bits: int):
        self.bits, self.hot = bits, {}

    def __call__(self, lang: str, codes: list[np.ndarray]) -> np.ndarray:
        h = phrase_hash(lang, codes[:-1] or codes)
        hot = self.hot.get(len(codes) - 1)
        if hot is not None and len(hot):
            k = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            spread = hot[k] == h
            h[spread] = phrase_hash(lang, [c[spread] for c in codes])
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)


def _pass(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(FILTER_BITS - 1)
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts


class _Counter:
    """A task's phrases of n words in one language: words numbered as they come, phrases as packed numbers."""

    def __init__(self, lang: str, n: int, filters: dict):
        self.lang, self.n, self.filters = lang, n, filters
        self.ids: dict[bytes, int] = {_STOP: 0}  # 0: what no phrase runs over, a stop or a word that is not frequent
        self.codes, self.names = [0], [b""]
        self.keys: list[list[np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def _number(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.ids))
        if new:
            codes = [word_code(w) for w in new]
            wanted = _pass(self.filters[1], phrase_hash(self.lang, [np.array(codes, np.uint64)])).tolist() if self.n > 1 else [True] * len(new)
            for w, c, ok in zip(new, codes, wanted, strict=True):
                self.ids[w] = len(self.codes) if ok else 0
                if ok:
                    self.codes.append(c)
                    if self.n == 1:
                        self.names.append(w)
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def add(self, texts: list[bytes]) -> None:
        words = b" . ".join(texts).lower().translate(_BREAKS).replace(_STOP, b" . ").split()
        ids, n = self._number(words), self.n
        if len(ids) < n:
            return
        ok = ids > 0
        if n > 2:
            ok = np.logical_and.reduce([ok[j : len(ok) - n + 2 + j] for j in range(n - 1)])
            at = np.flatnonzero(ok)
            codes = np.array(self.codes, np.uint64)
            ok[at] = _pass(self.filters[n - 1], phrase_hash(self.lang, [codes[ids[at + j]] for j in range(n - 1)]))
            ok = ok[1:] & ok[:-1]
        elif n == 2:
            ok = ok[1:] & ok[:-1]
        at = np.flatnonzero(ok)
        packed = np.zeros(len(at), np.int64)
        for j in range(min(n, 3)):
            packed = packed << ID_BITS | ids[at + j]
        keys, counts = _summed([packed, ids[at + 3]] if n > 3 else [packed], np.ones(len(at), np.int64))
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(counts)

    def shrink(self) -> None:
        if len(self.keys) > 1:
            keys, counts = _summed([np.concatenate(k) for k in zip(*self.keys, strict=True)], np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(counts)

    def automata(self, route: Routes) -> Iterator[dict]:
        """A row for each range."""
        self.shrink()
        if not self.held:
            return
        (keys,), (counts,) = self.keys, self.counts
        mask = (1 << ID_BITS) - 1
        columns = [keys[0] >> (ID_BITS * j) & mask for j in reversed(range(min(self.n, 3)))] + keys[1:]
        codes = np.array(self.codes, np.uint64)
        where = route(self.lang, [codes[c] for c in columns])
        order = np.argsort(where, kind="stable")
        where, counts, columns = where[order], counts[order], [c[order] for c in columns]
        begins = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(where)], strict=True):
            labels, inverse = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
            yield _row(self.lang, int(where[a]), 0, codes[labels], [self.names[k] for k in labels.tolist()] if self.n == 1 else [], np.split(inverse, self.n), counts[a:b])


def _row(lang: str, where: int, total: int, codes: np.ndarray, words: list, columns: list[np.ndarray], weights: np.ndarray) -> dict:
    sizes, arcs, ends = build(columns)
    return {"lang": lang, "range": where, "total": total, "codes": codes.view(np.int64), "words": words, "sizes": sizes, "arcs": arcs, "ends": ends, "weights": weights}


_ARROW = pa.schema(
    [("lang", pa.string()), ("range", pa.int64()), ("total", pa.int64()), ("codes", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("arcs", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))]
)


def _batches(rows: Iterator[dict], at_once: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == at_once:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([[w.decode() for w in r["words"]] for r in rows], f.type) if f.name == "words" else pa.array([r[f.name] for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _automata(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, int, int, list, list[np.ndarray], np.ndarray]]:
    """(lang, range, total, words of the labels, columns of codes, weights) of each row."""
    lists = {}
    for name in ("codes", "sizes", "arcs", "ends", "weights"):
        c = batch.column(name)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        lists[name] = (c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) if len(c) else (np.zeros(0), np.zeros(1))
    part = lambda name, i: lists[name][0][lists[name][1][i] : lists[name][1][i + 1]]
    for i in range(batch.num_rows):
        codes = part("codes", i).view(np.uint64)
        columns = unfold(part("sizes", i), part("arcs", i), part("ends", i)) if len(part("sizes", i)) else []
        yield batch.column("lang")[i].as_py(), batch.column("range")[i].as_py(), batch.column("total")[i].as_py(), batch.column("words")[i], [codes[c] for c in columns], part("weights", i)


def _shards(docs: DataFrame, n: int, filters: dict, route: Routes) -> DataFrame:
    """Automata of the counts of phrases of n words in each task's texts, one for each range."""
    shared = docs.sparkSession.sparkContext.broadcast((filters, route))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        filters, route = shared.value
        counters: dict[str, _Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for c in counters.values():
                yield from _batches(c.automata(route))
            counters.clear()

        def take(lang: str, texts: list[bytes]) -> bool:
            counters.setdefault(lang, _Counter(lang, n, filters)).add(texts)
            if sum(c.held for c in counters.values()) > HELD_PHRASES:
                for c in counters.values():
                    c.shrink()
            return sum(c.held for c in counters.values()) > HELD_PHRASES // 2 or sum(len(c.ids) for c in counters.values()) > HELD_WORDS

        for b in batches:
            waiting: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), strict=True):
                if text:
                    raw = text.encode()
                    waiting.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw)
                    if size[lang] >= BLOCK_BYTES and take(lang, waiting.pop(lang)):
                        yield from flush()
                    if lang not in waiting:
                        size[lang] = 0
            for lang, texts in waiting.items():
                if take(lang, texts):
                    yield from flush()
        yield from flush()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, AUTOMATON)


def _union(shards: DataFrame, least: int) -> DataFrame:
    """One automaton of the frequent phrases of each language and range; total is the sum of all weights, those left out included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        yield from _batches(ranges(batches))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        here, columns, weights, held = None, [], [], 0
        names: dict[int, str] = {}

        def shrink() -> None:
            nonlocal columns, weights, held
            c, w = _summed([np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate(weights))
            columns, weights, held = [c], [w], len(w)

        def close() -> dict:
            shrink()
            often = weights[0] >= least
            kept = [c[often] for c in columns[0]]
            labels, inverse = np.unique(np.concatenate(kept), return_inverse=True)
            words = [names[c].encode() for c in labels.tolist()] if names else []
            return _row(*here, int(weights[0].sum()), labels, words, np.split(inverse, len(kept)), weights[0][often])

        for b in batches:
            for lang, where, _, words, cols, w in _automata(b):
                if here != (lang, where):
                    if here:
                        yield close()
                    here, columns, weights, held = (lang, where), [], [], 0
                    names.clear()
                columns.append(cols)
                weights.append(w)
                held += len(w)
                if len(words):  # the labels of a single level are in the order of its arcs
                    for c, name in zip(cols[0].tolist(), words.values.to_numpy(zero_copy_only=False), strict=True):
                        if names.setdefault(c, name) != name:
                            raise ValueError(f"the words {name!r} and {names[c]!r} have one code")
                if held > 2 * HELD_PHRASES:
                    shrink()
        if here:
            yield close()

    return shards.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(run, AUTOMATON)


def _hashes(automata: DataFrame, least: int = 0) -> DataFrame:
    """(h): the hash of each phrase that occurs least times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, _, _, _, columns, weights in _automata(b):
                if len(weights):
                    yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(lang, columns)[weights >= least].view(np.int64))], ["h"])

    return automata.mapInArrow(run, "h long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Built by Spark in buckets; FILTER_BITS / 8 bytes reach the driver, whatever the number of hashes."""
    at = F.col("h").bitwiseAND(FILTER_BITS - 1) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    return out


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[dict[int, DataFrame], Routes]:
    """Automata of the phrases of 1 to longest words that occur least times, by their number of words; and their ranges."""
    docs = bounded_batches(docs)
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    route = Routes(max(0, min(MOST_RANGES, size // RANGE_BYTES)).bit_length())
    filters: dict[int, np.ndarray] = {}
    found: dict[int, DataFrame] = {}
    share = 0
    for n in range(1, longest + 1):
        found[n] = spool(_union(_shards(docs, n, filters, route), least), f"phrases{n}")
        if n == 1:
            share = (found[1].agg(F.sum("total").alias("n")).first()["n"] or 0) >> route.bits
        if n < longest:
            filters = {1: filters.get(1), n: _bitmap(_hashes(found[n]))}
            # at most as many as there are ranges, as each holds a range's share of all words
            often = [r["h"] for r in _hashes(found[n], max(least, share)).collect()] if route.bits else []
            route.hot[n] = np.sort(np.array(often, np.int64).view(np.uint64))
    return found, route


def _expanded(automata: DataFrame) -> DataFrame:
    """(lang, codes, a): a row for each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, _, _, _, columns, weights in _automata(b):
                m, n = len(weights), len(columns)
                flat = np.stack(columns, axis=1).reshape(-1).view(np.int64) if m else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * n), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), lists, pa.array(weights)], ["lang", "codes", "a"])

    return automata.mapInArrow(run, "lang string, codes array<long>, a long")


def _unexplained(phrases: DataFrame) -> DataFrame:
    """The phrases that no longer one with a count of EXPLAINED percent holds."""
    size = F.size("codes")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("codes", i, k))))
    most = phrases.where(size > 2).select("lang", F.explode(inner).alias("codes"), "a").groupBy("lang", "codes").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return phrases.join(most, ["lang", "codes"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < EXPLAINED * wide("a"))).drop("longer")


def _parts(phrases: DataFrame, route: Routes) -> DataFrame:
    """(lang, codes, a, slot, level, range, part): l1.. and r1.. are the parts of each cut, w.. the words that are no such part."""
    shared = phrases.sparkSession.sparkContext.broadcast(route)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = shared.value
        for b in batches:
            lists = b.column(1)
            sizes, langs = np.diff(lists.offsets.to_numpy()), b.column(0).to_numpy(zero_copy_only=False)
            values, begin = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()[:-1]
            for lang in dict.fromkeys(langs):
                for n in np.unique(sizes[langs == lang]).tolist():
                    rows = np.flatnonzero((langs == lang) & (sizes == n))
                    columns = [values[begin[rows] + j] for j in range(n)]
                    slots = {f"l{k}": (0, k) for k in range(1, n)} | {f"r{k}": (k, n) for k in range(1, n)} | {f"w{k}": (k, k + 1) for k in range(1, n - 1)}
                    own = b.take(pa.array(rows))
                    for slot, (i, j) in slots.items():
                        part = columns[i:j]
                        lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (j - i)), pa.array(np.stack(part, axis=1).reshape(-1).view(np.int64)))
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([slot] * len(rows)), pa.array(np.full(len(rows), j - i, np.int32)), pa.array(route(lang, part)), lists_], ["lang", "codes", "a", "slot", "level", "range", "part"])

    return phrases.select("lang", "codes", "a").mapInArrow(run, "lang string, codes array<long>, a long, slot string, level int, range long, part array<long>")


def _followed(parts: DataFrame, found: dict[int, DataFrame]) -> DataFrame:
    """(lang, codes, a, slot, f, word): parts composed with the automata of their ranges; word where a part is a single one."""
    key = ["lang", "level", "range"]
    groups = parts.groupBy(*key).agg(F.ceil(F.count("*") / GROUP_PARTS).cast("int").alias("groups"))
    asked = parts.join(groups, key).withColumn("group", F.pmod(F.xxhash64("codes", "slot"), "groups").cast("int")).drop("groups")
    automata = None
    for n, df in found.items():
        df = df.withColumn("level", F.lit(n))
        automata = df if automata is None else automata.unionByName(df)
    automata = automata.join(groups, key).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "total")

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "codes": pa.array([], pa.list_(pa.int64())), "a": pa.array([], pa.int64()), "slot": pa.array([], pa.string()), "f": pa.array([], pa.int64()), "word": pa.array([], pa.string())})
        level = left.column("level")[0].as_py()
        (_, _, _, words, columns, weights), = _automata(right.append_column("total", pa.array([0], pa.int64())))
        part = left.column("part").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, level)
        # both sides as numbers of the labels, then one search of the sorted paths for each level
        state_of = np.zeros(len(part), np.int64)
        own = np.zeros(len(weights), np.int64)
        for j in range(level):
            pair = np.concatenate([np.stack([own, columns[j].view(np.int64)], 1), np.stack([state_of, part[:, j].view(np.int64)], 1)])
            _, number = np.unique(pair, axis=0, return_inverse=True)
            own, state_of = number.reshape(-1)[: len(own)], number.reshape(-1)[len(own) :]
        order = np.argsort(own)
        at = order[np.searchsorted(own[order], state_of)]
        word = words.values.take(pa.array(at)) if level == 1 else pa.nulls(len(at), pa.string())
        return left.select(["lang", "codes", "a", "slot"]).append_column("f", pa.array(weights[at])).append_column("word", word)

    return asked.groupBy(*key, "group").cogroup(automata.groupBy(*key, "group")).applyInArrow(follow, "lang string, codes array<long>, a long, slot string, f long, word string")


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by their weakest cut.

    a, l, r are the counts of the phrase and of the parts at the cut of lowest floor(2000000 a / (l + r)), at the first such; n is the number of the
    language's words. A null lang counts as `und`, a null text as empty; repeated rows count again; ids are not looked at. Other
    columns are ignored. An empty table gives no rows.
    """
    found, route = frequent_phrases(docs, longest, least)
    phrases = None
    for n in range(2, longest + 1):
        rows = _expanded(found[n])
        phrases = rows if phrases is None else phrases.unionByName(rows)
    kept = spool(_unexplained(phrases), "phrases")
    slot = lambda name, c: F.max(F.when(F.col("slot") == name, F.col(c)))
    cuts = range(1, longest)
    wide = _followed(_parts(kept, route), found).groupBy("lang", "codes").agg(
        F.max("a").alias("a"), *(slot(s + str(k), "f").alias(s + str(k)) for s in "lr" for k in cuts), slot("l1", "word").alias("first"),
        F.max(F.when((F.substring("slot", 1, 1) == "r") & F.col("word").isNotNull(), F.col("word"))).alias("last"), *(slot(f"w{k}", "word").alias(f"w{k}") for k in range(1, longest - 1)),
    )

    def cut(k: int) -> Column:
        l, r = F.col(f"l{k}").cast("decimal(20,0)"), F.col(f"r{k}").cast("decimal(20,0)")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"({SCALE} * cast(a as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    worst = F.least(*(cut(k) for k in cuts)) if longest > 2 else cut(1)
    scored = wide.select("lang", F.concat_ws(" ", "first", *(f"w{k}" for k in range(1, longest - 1)), "last").alias("phrase"), "a", worst.alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    totals = found[1].groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
