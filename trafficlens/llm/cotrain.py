"""Quality: co-training of a text-content view and a page-metadata view.

The text view sees what is written (hashed byte pairs, letter case, marks, repeated words); the metadata view sees what the page
says about itself and how it is laid out (language, source, length, line lengths and ends, column bars, ornament, headline
capitals), never its words. Both are logistic models. They start from labelled rows; in each round each view labels, among all
documents without a label, the ones it is most sure of, and these join the training rows of the other view only. Where the views
contradict each other, neither teaches. A document that has been handed over is not looked at again, so that no view's label comes
back to it. Each view is then calibrated on labelled rows that no training used, and a logistic model of the two calibrated logits
scores every document.

Features of all documents are computed in one pass and kept in the shared folder; every round searches all of them for confident
documents, in one pass. The training rows are bounded: SAMPLE_DOCS labelled ones and PER_ROUND new ones for each round, class and
view.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, split_by_ids, spool
from .textblocks import Block, blocks
from .toxicity import hold_out, platt

SAMPLE_DOCS = 8_000
PER_ROUND = 150
ROUNDS = 3
#: A view labels for the other only above the score at which its labels hold for this share of the calibration rows, of which at
#: least SUPPORT must lie there. A weak view, which nothing makes so sure, teaches nothing.
PRECISION = 0.995
SUPPORT = 40
PAIR_BINS = 256
LANG_BINS, SOURCE_BINS = 8, 32
BLOCK_BYTES = 1 << 19
N_STATS, N_LAYOUT = 10, 12
TEXT_DIM = PAIR_BINS + N_STATS
META_DIM = LANG_BINS + SOURCE_BINS + N_LAYOUT

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _shares(flags: np.ndarray, block: Block, size: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[block.offsets[1:]] - total[block.offsets[:-1]]) / size


def text_features(block: Block) -> np.ndarray:
    """(documents, TEXT_DIM) float16; a document without text has zeros."""
    raw, n = block.raw, block.n
    size = np.maximum(np.diff(block.offsets), 1)
    doc = np.repeat(np.arange(n), np.diff(block.offsets))
    pair = np.zeros(len(raw), np.int64)
    if len(raw):
        pair[:-1] = (raw[:-1].astype(np.int64) * 31 + raw[1:].astype(np.int64) * 17) % PAIR_BINS
    bins = np.bincount(doc * PAIR_BINS + pair, minlength=n * PAIR_BINS).reshape(n, PAIR_BINS)
    words = np.maximum(block.n_words, 1)
    hashes = block.word_hash()
    distinct, repeats, most = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        h = hashes[block.word_offsets[i] : block.word_offsets[i + 1]]
        if len(h):
            count = np.unique(h, return_counts=True)[1]
            distinct[i], most[i], repeats[i] = len(count), count.max(), (h[1:] == h[:-1]).sum()
    stats = np.stack(
        [
            *(_shares(flag[raw], block, size) for flag in (_UPPER, _LETTER, _DIGIT, _MARK)),
            distinct / words, distinct / words * np.log1p(words) / 5, repeats / words, most / words, np.minimum(size / words, 40) / 10, np.log1p(words) / 10,
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(bins / size[:, None]), stats], axis=1).astype(np.float16)


def meta_features(block: Block, lang: list, source: list, n_chars: list) -> np.ndarray:
    """(documents, META_DIM) float16. Unknown (null) languages and sources have bins of their own; a null length counts as 0."""
    n = block.n
    out = np.zeros((n, META_DIM), np.float32)
    for i in range(n):
        out[i, crc32(repr(lang[i]).encode()) % LANG_BINS] = 1
        out[i, LANG_BINS + crc32(repr(source[i]).encode()) % SOURCE_BINS] = 1
    at = LANG_BINS + SOURCE_BINS
    size = np.maximum(np.diff(block.offsets), 1)
    lines = _shares(block.raw == 10, block, np.ones(n)) + 1
    chars = np.array([x or 0 for x in n_chars], np.float64)
    out[:, at] = np.log1p(np.maximum(chars, 0)) / 10
    out[:, at + 1] = np.log1p(lines) / 5
    out[:, at + 2] = np.log1p(size / lines) / 8
    out[:, at + 3] = size / np.maximum(chars, 1) - 1
    out[:, at + 4] = np.log1p(block.n_words / lines) / 5
    out[:, at + 5] = block.n_words == 0
    words = np.maximum(block.n_words, 1)
    raw = block.raw
    out[:, at + 6] = np.sqrt(_shares(raw == 124, block, words))  # column bars
    ornament = np.zeros(len(raw), bool)
    if len(raw):
        ornament[1:] = _MARK[raw[1:]] & (raw[1:] == raw[:-1])
    out[:, at + 7] = np.sqrt(_shares(ornament, block, words))
    out[:, at + 8 : at + 12] = _line_shares(block)
    return np.clip(out, -8, 8).astype(np.float16)


def _line_shares(block: Block) -> np.ndarray:
    """(documents, 4): shares of lines in capitals, of empty lines and of lines that end in a full stop; the longest line (log)."""
    raw, n = block.raw, block.n
    begins = np.zeros(len(raw) + 1, bool)
    begins[block.offsets] = True
    begins[1:] |= raw == 10
    begins = np.flatnonzero(begins[:-1])
    out = np.zeros((n, 4))
    if not len(begins):
        return out
    doc = np.searchsorted(block.offsets, begins, side="right") - 1
    size = np.diff(np.append(begins, len(raw)))
    count = lambda flags: np.add.reduceat(flags.astype(np.int32), begins)
    letters, upper = count(_LETTER[raw]), count(_UPPER[raw])
    stop = raw[np.append(begins[1:], len(raw)) - 1] == 46
    lines = np.maximum(np.bincount(doc, minlength=n), 1)
    for k, flag in enumerate(((upper > 0.6 * letters) & (letters > 3), letters == 0, stop)):
        out[:, k] = np.bincount(doc, flag, n) / lines
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    out[:, 3] = np.log1p(longest) / 8
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m): both views' features of every row, packed as float16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1), BLOCK_BYTES):
                own = b.slice(block.first, block.n)
                t, m = text_features(block), meta_features(block, *(own.column(k).to_pylist() for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["doc_id", "t", "m"])

    return docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(run, "doc_id long, t binary, m binary")


@dataclass
class Linear:
    """A logistic model over standardised features, with Platt calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> Linear:
        mean, spread = x.mean(0), x.std(0) + 1e-3
        z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
        w = np.zeros(z.shape[1])
        pull = np.full(len(w), ridge)
        pull[-1] = 1e-6
        for _ in range(steps):  # iteratively reweighted least squares
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + pull * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(pull), grad)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        return cls(mean, spread, w[:-1], float(w[-1]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.scale * (((x - self.mean) / self.spread) @ self.weights + self.bias) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.scale, self.shift = 1.0, 0.0
        self.scale, self.shift = platt(self.logits(x), y)


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, dim).astype(np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sure_from(sure: np.ndarray, right: np.ndarray) -> float:
    """The lowest certainty from which on all higher cuts of the calibration rows reach PRECISION; above 1 if there is none."""
    order = np.argsort(-sure, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= PRECISION)
    return float(sure[order[good[-1]]]) if len(good) and good[-1] + 1 >= SUPPORT else 2.0


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    join: Linear
    #: For each round, how many labels each view handed to the other: {(view, class): labels}; view 0 is the text view.
    handed: list[dict] = field(default_factory=list)


def _confident(pool: DataFrame, views: tuple[Linear, Linear], limits: dict, per_round: int, taught: set) -> list:
    """The documents that each view is most sure of, per_round for each view and class at most, over all of pool but the taught ones.

    One pass: every partition keeps its own best, and the best of all are chosen from these.
    """
    shared = pool.sparkSession.sparkContext.broadcast((views, np.array(sorted(taught), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, old = shared.value
        best: dict = {}
        for b in batches:
            fresh = ~np.isin(b.column(0).to_numpy(zero_copy_only=False), old)
            for k, dim in ((0, TEXT_DIM), (1, META_DIM)):
                p = sigmoid(views[k].logits(_unpack(b.column(1 + k).to_pylist(), dim)))
                for y, sure in ((1, p), (0, 1 - p)):
                    top = np.flatnonzero(fresh & (sure >= limits[k, y]))
                    top = top[np.argsort(-sure[top], kind="stable")[:per_round]]
                    part = pa.Table.from_arrays([pa.array(np.full(len(top), k), pa.int32()), pa.array(np.full(len(top), y), pa.int32()), pa.array(sure[top]), *(b.column(c).take(pa.array(top)) for c in range(3))], ["view", "y", "sure", "doc_id", "t", "m"])
                    had = best.get((k, y))
                    if had is not None:
                        part = pa.concat_tables([had, part])
                        part = part.take(pa.array(np.argsort(-part["sure"].to_numpy(), kind="stable")[:per_round]))
                    best[k, y] = part
        for part in best.values():
            yield from part.combine_chunks().to_batches()

    found = spool(pool.select("doc_id", "t", "m").mapInArrow(run, "view int, y int, sure double, doc_id long, t binary, m binary"), "quality-sure")
    shared.destroy()
    return [r for k in (0, 1) for y in (0, 1) for r in found.where((F.col("view") == k) & (F.col("y") == y)).orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id").limit(per_round).collect()]


def fit(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> CoTrained | None:
    """Both views and their combination. Learns from labelled rows outside the held-out fold; None without both classes."""
    may, rest = split_by_ids(feats, labels.select("doc_id").where("doc_id is not null"))
    listed = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.lit(True).alias("labelled"))
    feats = may.join(listed, "doc_id", "left").unionByName(rest.select("*", F.lit(None).cast("int").alias("y"), F.lit(None).cast("boolean").alias("labelled")))
    feats = spool(feats, "quality-labelled")
    marked = feats.where(~hold_out()).where("y is not null")
    half = sample // 2
    parts = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)]
    got = sorted({r["doc_id"]: r for r in parts[0].unionByName(parts[1]).collect()}.values(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], float)
    if len(y) < 4 or y.min() == y.max():
        return None
    t, m = _unpack([r["t"] for r in got], TEXT_DIM), _unpack([r["m"] for r in got], META_DIM)
    # every fifth row of each class calibrates; the others train
    place = np.zeros(len(y), int)
    for c in (0, 1):
        place[y == c] = np.arange((y == c).sum())
    check = place % 5 == 4
    if not (0 < y[check].sum() < check.sum()):
        check = np.zeros(len(y), bool)
    own = check if check.any() else np.ones(len(y), bool)
    rows = {"t": [t[~check], y[~check]], "m": [m[~check], y[~check]]}
    pool = feats.where("labelled is null and doc_id is not null")
    taught: set = set()
    handed = []
    for k in range(rounds + 1):
        text, meta = Linear.fit(*rows["t"]), Linear.fit(*rows["m"])
        text.calibrate(t[own], y[own])
        meta.calibrate(m[own], y[own])
        if k == rounds:
            break
        limits = {}
        for v, p in enumerate((sigmoid(text.logits(t[own])), sigmoid(meta.logits(m[own])))):
            limits[v, 1], limits[v, 0] = _sure_from(p, y[own] == 1), _sure_from(1 - p, y[own] == 0)
        new = {(r["view"], r["doc_id"]): r for r in _confident(pool, (text, meta), limits, per_round, taught)}
        taught |= {d for _, d in new}
        new = [r for (v, d), r in new.items() if (1 - v, d) not in new or new[1 - v, d]["y"] == r["y"]]
        handed.append({(v, c): sum(r["view"] == v and r["y"] == c for r in new) for v in (0, 1) for c in (0, 1)})
        for view, other, dim in ((0, "m", META_DIM), (1, "t", TEXT_DIM)):  # what one view is sure of teaches the other
            mine = [r for r in new if r["view"] == view]
            if mine:
                rows[other][0] = np.concatenate([rows[other][0], _unpack([r[other] for r in mine], dim)])
                rows[other][1] = np.concatenate([rows[other][1], [r["y"] for r in mine]])
    both = np.stack([text.logits(t[own]), meta.logits(m[own])], 1)
    return CoTrained(text, meta, Linear.fit(np.clip(both, -12, 12), y[own], ridge=0.1), handed)


def combined(model: CoTrained, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances of good quality by the text view, by the metadata view and by both."""
    zt, zm = model.text.logits(t), model.meta.logits(m)
    return sigmoid(zt), sigmoid(zm), sigmoid(model.join.logits(np.clip(np.stack([zt, zm], 1), -12, 12)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, text_score, meta_score, score, predicted) for every row: score is the chance of good quality.

    Null and empty texts are scored like any other. Without labels of both classes every score is 1. Repeated rows give
    repeated results; an empty table gives no rows. Extra columns are ignored.
    """
    feats = spool(features(bounded_batches(docs)), "quality-features")
    model = fit(feats, labels)
    if model is None:
        one = F.lit(1.0)
        return feats.select("doc_id", hold_out().alias("held_out"), one.alias("text_score"), one.alias("meta_score"), one.alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = combined(shared.value, _unpack(b.column(1).to_pylist(), TEXT_DIM), _unpack(b.column(2).to_pylist(), META_DIM))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, views)], ["doc_id", "text_score", "meta_score", "score"])

    scored = feats.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return scored.select("doc_id", hold_out().alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are likelier good than not. Without labels of both classes all stay.

    Null and empty texts, repeated rows and rows without id are judged like any other; an empty table stays empty.
    """
    model = fit(spool(features(bounded_batches(docs)), "quality-features"), labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, lang, source, n_chars = (names.index(c) for c in ("text", "lang", "source", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(text), BLOCK_BYTES):
                own = b.slice(block.first, block.n)
                m = meta_features(block, *(own.column(k).to_pylist() for k in (lang, source, n_chars)))
                # as stored for training: half precision
                p = combined(shared.value, text_features(block).astype(np.float64), m.astype(np.float64))[2]
                yield own.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(run, docs.schema)
