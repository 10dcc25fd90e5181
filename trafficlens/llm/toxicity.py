"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one table, chosen by hashes of the whole word and of its first four and five bytes,
so that inflected forms share their stem. Filters one, two and three words wide run over the whole text, each filter's largest
value is kept, and a logistic layer gives the score, calibrated on part of the sample. A further threshold for each language,
calibrated on the same part, decides what a filtering stage rejects; language takes no part in the score.

The model is fitted on at most SAMPLE_DOCS labelled documents of at most SAMPLE_WORDS words together, whole documents only, taken
in hash order of the id; scoring covers every word of every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, spool
from .textblocks import Block, blocks

SAMPLE_DOCS = 5_000
SAMPLE_WORDS = 4_000_000
TABLE_ROWS = 1 << 16
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 5
BATCH = 48
BLOCK_BYTES = 1 << 18


def word_rows(block: Block) -> np.ndarray:
    """(words, 3): table rows of each word."""
    mask = np.uint64(TABLE_ROWS - 1)
    spans = [block.word_hash()]
    for k, salt in ((4, 0x51ED270B), (5, 0x2545F491)):
        spans.append(block.span_hash(block.start, np.minimum(block.start + k, block.end)) + np.uint64(salt))
    return np.stack([((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & mask for h in spans], axis=1).astype(np.int32)


@dataclass
class ConvModel:
    table: np.ndarray
    kernels: list[np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> ConvModel:
        kernels = [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return cls(rng.normal(0, 0.3, (TABLE_ROWS, DIM)).astype(np.float32), kernels, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)

    def pooled(self, rows: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter in each document (no value: 0), and where it stands."""
        n = len(offsets) - 1
        best = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1, np.int64) if places else None
        if not len(rows):
            return best, where
        x = self.table[rows[:, 0]]
        x += self.table[rows[:, 1]]
        x += self.table[rows[:, 2]]
        for k, w in enumerate(WIDTHS):
            count = len(x) - w + 1
            if count <= 0:
                continue
            z = x[:count] @ self.kernels[k][0]
            for j in range(1, w):
                z += x[j : j + count] @ self.kernels[k][j]
            long = np.flatnonzero(np.diff(offsets) >= w)
            if not len(long):
                continue
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if places:
                for d in long:
                    a, b = offsets[d], offsets[d + 1] - w + 1
                    at = z[a:b].argmax(0)
                    where[d, cols] = a + at
                    best[d, cols] = z[a + at, np.arange(FILTERS)]
            else:
                # pairs of bounds; the odd stretches between them are skipped
                bounds = np.stack([offsets[long], offsets[long + 1] - w + 1], axis=1).ravel()
                if bounds[-1] == count:
                    bounds = bounds[:-1]
                best[long, cols] = np.maximum.reduceat(z, bounds, axis=0)[::2]
        return best, where

    def logits(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(rows, offsets)
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def scores(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(rows, offsets).astype(np.float64))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -35, 35)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state = rate, {}

    def step(self, key, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if key not in self.state:
            self.state[key] = [np.zeros_like(value), np.zeros_like(value), 0]
        m, v, t = self.state[key]
        self.state[key][2] = t = t + 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= self.rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)


def _take(rows: list[np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chosen = [rows[i] for i in index]
    return np.concatenate(chosen), np.concatenate(([0], np.cumsum([len(c) for c in chosen])))


def _train(rows: list[np.ndarray], y: np.ndarray, epochs: int, seed: int = 11) -> ConvModel:
    rng = np.random.Generator(np.random.PCG64(seed))
    model, adam = ConvModel.fresh(rng), _Adam(0.01)
    weight = np.where(y == 1, min(4.0, max(1.0, (1 - y.mean()) / max(y.mean(), 1e-3))), 1.0).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            index = order[s : s + BATCH]
            batch, offsets = _take(rows, index)
            best, where = model.pooled(batch, offsets, places=True)
            h = np.maximum(best + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.out_bias, -30, 30)))
            g = ((p - y[index]) * weight[index] / len(index)).astype(np.float32)
            gh = g[:, None] * model.out * (h > 0)
            adam.step("out", model.out, h.T @ g + 1e-5 * model.out)
            shift = np.array([model.out_bias], np.float32)
            adam.step("out_bias", shift, np.array([g.sum()], np.float32))
            model.out_bias = float(shift[0])
            adam.step("bias", model.bias, gh.sum(0))
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                at, gk = where[:, k * FILTERS : (k + 1) * FILTERS], gh[:, k * FILTERS : (k + 1) * FILTERS]
                d, f = np.nonzero((at >= 0) & (gk != 0))
                if not len(d):
                    continue
                gv, pos = gk[d, f], at[d, f]
                gw = np.zeros_like(model.kernels[k])
                for j in range(w):
                    ids = batch[pos + j]
                    x = model.table[ids].sum(1)
                    np.add.at(gw[j].T, f, gv[:, None] * x)
                    gx = gv[:, None] * model.kernels[k][j][:, f].T
                    touched.append(ids.ravel())
                    grads.append(np.repeat(gx, 3, axis=0))
                adam.step(("kernel", k), model.kernels[k], gw)
            if touched:
                ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(grads))
                adam.step("table", model.table, total, ids)
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make a logit a probability: Newton steps on smoothed targets, with a ridge that keeps both finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1).astype(np.float64)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        grad = x.T @ (p - t) + 1e-3 * np.array([a - 1, b])
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest score gap with the best F1, within 0.4 to 0.7; 0.5 where one class is missing."""
    if y.sum() < 5 or (1 - y).sum() < 5:
        return 0.5
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    s = np.append(p[order], 0.0)
    k = best[np.argmax(s[best] - s[best + 1])]
    return float(np.clip((s[k] + s[k + 1]) / 2, 0.4, 0.7))


def hold_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is in the fold that training leaves out; a row without id is in none."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_words: int) -> list:
    """Hashed words, label and language of a bounded labelled sample of whole documents.

    Of each class, the first max_docs / 2 labelled rows in hash order are looked up; of these, taken in hash order, every document
    that still fits into max_words is used, from its first word to its last, and one that does not fit is left out.
    """
    # one label for each document, should a table repeat it
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = docs.select("doc_id").where(~hold_out()).join(known, "doc_id").dropDuplicates(["doc_id"])
    half = max_docs // 2
    rare = wanted.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
    rest = wanted.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs - half)
    chosen = {r[0]: r[1] for r in rare.unionByName(rest).collect()}
    if not chosen:
        return []
    # at most max_docs ids, whatever the table's size
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.filter(pa.array([d in shared.value for d in b.column(0).to_pylist()], pa.bool_()))
            for block in blocks(own.column(1), BLOCK_BYTES):
                rows, part = word_rows(block), own.slice(block.first, block.n)
                words = [rows[i:j].tobytes() for i, j in zip(block.word_offsets[:-1], block.word_offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(block.n_words, pa.int64()), pa.array(words, pa.binary())], ["doc_id", "lang", "n", "words"])

    found = spool(docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, "doc_id long, lang string, n long, words binary"), "toxicity-sample")
    shared.destroy()
    fit_in, total = [], 0
    for d, n in sorted(((r[0], r[1]) for r in found.groupBy("doc_id").agg(F.max("n")).collect()), key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r[0])):
        if total + n <= max_words:
            fit_in.append(d)
            total += n
    got = {r[0]: r for r in found.where(F.col("doc_id").isin(fit_in)).collect()} if fit_in else {}
    return [(np.frombuffer(got[d]["words"], np.int32).reshape(-1, 3), chosen[d], got[d]["lang"]) for d in fit_in]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_words: int = SAMPLE_WORDS, epochs: int = EPOCHS) -> ConvModel:
    """Trains on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    Without labelled rows, or with one class only, the score is that class's smoothed share everywhere.
    """
    sample = _sample(bounded_batches(docs), labels, max_docs, max_words)
    y = np.array([s[1] for s in sample], np.float32)
    if not len(y) or y.min() == y.max():
        model = ConvModel.fresh(np.random.Generator(np.random.PCG64(0)))
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.01
        model.out[:], model.out_bias = 0, float(np.log(share / (1 - share)))
        return model
    rows, lang = [s[0] for s in sample], np.array([s[2] or "" for s in sample])
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 100 else np.zeros(len(y), bool)
    use = np.flatnonzero(~check)
    model = _train([rows[i] for i in use], y[use], epochs if len(y) >= 1500 else epochs * max(2, min(8, 3000 // len(y))))
    held = np.flatnonzero(check) if check.any() else use
    z = model.logits(*_take(rows, held)).astype(np.float64)
    # the sample holds more toxic rows than the corpus; the shift back is left to the threshold at 0.5 of balanced odds
    model.scale, model.shift = platt(z, y[held])
    p = model.calibrated(z)
    for name in np.unique(lang[held]):
        own = lang[held] == name
        if own.sum() >= 40:
            model.thresholds[str(name)] = _threshold(p[own], y[held][own])
    return model


def _judged(part: pa.RecordBatch, block: Block, model: ConvModel, lang: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a block's rows and the thresholds of their languages (0.5 where none was calibrated)."""
    limits = [model.thresholds.get(x or "", 0.5) for x in part.column(lang).to_pylist()] if lang >= 0 else [0.5] * block.n
    return model.scores(word_rows(block), block.word_offsets), np.array(limits)


def score(docs: DataFrame, model: ConvModel) -> DataFrame:
    """(doc_id, toxicity 0 to 1, toxic_threshold, toxic) for every row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(1), BLOCK_BYTES):
                part = b.slice(block.first, block.n)
                p, limit = _judged(part, block, shared.value, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(limit), pa.array(p >= limit)], ["doc_id", "toxicity", "toxic_threshold", "toxic"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, toxicity double, toxic_threshold double, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below their language's threshold. Trains on docs and labels; no shuffle.

    Null and empty texts, repeated rows and rows without id are judged like any other; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(text), BLOCK_BYTES):
                part = b.slice(block.first, block.n)
                p, limit = _judged(part, block, shared.value, lang)
                yield part.filter(pa.array(p < limit))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, rejected) for every document; null and empty texts are scored too.

    Repeated rows give repeated results; an empty table gives no rows. Extra columns are ignored.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", hold_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.col("toxic_threshold").alias("lang_threshold"), F.col("toxic").alias("rejected"))
