"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(word | context) = log P(class | context) + log P(cell | class, context) + log P(word | cell). Both softmax factors are
log-linear over hashed features of the context. For the class: the word before, the word two before (skip), both words (trigram) and
the classes of both. For the cell within its class: the word before and the word two before, each together with the class. A frequent
word has a cell of its own; rarer words of a class share cells of near equal mass, and within a cell the relative count decides.

Counts cover every training document. The HEAD most frequent words (as many as have one count or more in common) are broadcast;
their classes come from the documents they occur in (grouped by the bin of word hashes that is most frequent in a document) and their
frequency. All other words form one class, whose members' counts are looked up by a distributed join, so no table that grows with the
corpus is sent to the workers. Unseen words count as one further member of that class, so that probabilities sum to one.

Training: in each of ROUNDS rounds every part runs minibatch gradient steps from the shared weights over its share of the training
documents, each of which teaches both factors; the changes, weighted by each row's number of steps, are averaged by Spark and
applied. Weights have a fixed size. The parts are dealt by a hash of the document, their number follows from the number of tokens,
and each is read in the order of doc_id and text, so that equal tables give equal scores however they are stored. A word is known
by a 58-bit hash; of a billion words, two pairs may share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, spool
from .textblocks import Block, blocks
from .toxicity import hold_out

HEAD = 1 << 17
GROUPS = 8  # document groups that have classes of their own
#: Upper ends of the frequency bins as shares of a group's tokens, most frequent words first.
BIN_ENDS = (0.15, 0.35, 0.55, 0.75, 0.9)
BINS = len(BIN_ENDS) + 1
CELLS = 48  # in each class
TAIL, END = GROUPS * BINS, GROUPS * BINS + 1
CLASSES = GROUPS * BINS + 2
#: Rows of weights for each feature, 65,536 at most.
CLASS_SIZES = (1 << 14, 1 << 13, 1 << 14, (CLASSES + 1) ** 2)  # word, skip, pair, classes
CELL_SIZES = (1 << 15, 1 << 14)  # word, skip
ROUNDS = 2
STEP_TOKENS = 16384
RATE = 0.5
PIECE = 512  # weight rows sent as one
BLOCK_BYTES = 1 << 18
COUNT_TOKENS = 1 << 22  # words counted at once
PART_TOKENS = 1 << 21  # training tokens of one part, about
_DOC_GROUPS = 64
_HASH_BITS = 58
_BEGIN = np.uint64(0x25A5A5A55A5A5A5)
_STOP = np.uint64(0x23C3C3CCC3C3C3C)


def word_keys(block: Block) -> np.ndarray:
    return block.word_hash() >> np.uint64(64 - _HASH_BITS)


@dataclass
class Head:
    """The broadcast part of the vocabulary, sorted by hash, and the totals of all of it."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    cells: np.ndarray
    log_in_cell: np.ndarray  # natural log of the share within the cell
    docs: int
    tokens: int  # N
    types: int  # V
    tail_tokens: int
    tail_types: int

    def factors(self) -> list[Factor]:
        """The factors from which training starts: every context gives classes, and cells in a class, their overall shares."""
        mass = np.bincount(self.classes, self.counts, CLASSES)
        mass[TAIL], mass[END] = self.tail_tokens, self.docs
        prior = np.log(np.maximum(mass, 1e-3) / max(self.tokens, 1))
        inside = np.bincount(self.classes * CELLS + self.cells, self.counts, CLASSES * CELLS).reshape(CLASSES, CELLS)
        with np.errstate(divide="ignore"):
            inside = np.maximum(np.log(inside / np.maximum(inside.sum(1, keepdims=True), 1)), -30.0)
        return [
            Factor(np.tile((prior / len(CLASS_SIZES)).astype(np.float32), (sum(CLASS_SIZES), 1)), CLASS_SIZES),
            Factor(np.zeros((sum(CELL_SIZES), CELLS), np.float32), CELL_SIZES, inside.astype(np.float32)),
        ]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


@dataclass
class Factor:
    """One softmax: a row of weights for each value of each feature, and a fixed row for each value of base, if there is one."""

    weights: np.ndarray
    sizes: tuple[int, ...]
    base: np.ndarray | None = None

    def work(self) -> Factor:
        """A copy to train or score with, which has room for one step."""
        out = Factor(self.weights.copy(), self.sizes, self.base)
        n, width = STEP_TOKENS, self.weights.shape[1]
        out._z, out._e = np.empty((n, width), np.float32), np.empty((n, width), np.float32)
        out._ones = np.ones(width, np.float32)
        out.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        return out

    def trainable(self) -> Factor:
        out = self.work()
        out._speed = np.full(len(out.weights), 1e-2, np.float32)
        out.steps = np.zeros(len(out.weights), np.float32)
        return out

    def _forward(self, features: list[np.ndarray], place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials and the sums of those. features: uint16 rows of each feature's own part."""
        n = len(features[0])
        z, e = self._z[:n], self._e[:n]
        for k, f in enumerate(features):
            np.take(self.weights[self.starts[k] : self.starts[k + 1]], f, axis=0, out=e if k else z, mode="clip")
            if k:
                z += e
        if place is not None:
            np.take(self.base, place, axis=0, out=e, mode="clip")
            z += e
        np.clip(z, -40, 60, out=z)
        np.exp(z, out=e)
        return z, e, e @ self._ones

    def log_chances(self, features: list[np.ndarray], y: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        out = np.empty(len(y))
        for s in range(0, len(y), STEP_TOKENS):
            part = slice(s, s + STEP_TOKENS)
            z, _, total = self._forward([f[part] for f in features], None if place is None else place[part])
            out[part] = z[np.arange(len(z)), y[part]] - np.log(total)
        return out

    def train(self, features: list[np.ndarray], y: np.ndarray, place: np.ndarray | None = None) -> None:
        for s in range(0, len(y), STEP_TOKENS):
            part = slice(s, s + STEP_TOKENS)
            fs = [f[part] for f in features]
            room, g, total = self._forward(fs, None if place is None else place[part])
            g /= total[:, None]
            g[np.arange(len(g)), y[part]] -= 1
            for k, f in enumerate(fs):
                order = np.argsort(f, kind="stable")
                rows = f[order]
                at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                np.take(g, order, axis=0, out=room, mode="clip")
                grad = _row_sums(room, at, np.diff(np.append(at, len(rows))))
                ids = rows[at].astype(np.int64) + self.starts[k]
                self._speed[ids] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
                grad *= (RATE / len(fs) / np.sqrt(self._speed[ids]))[:, None]
                self.weights[ids] -= grad
                self.steps[ids] += np.diff(np.append(at, len(rows)))


def _row_sums(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; most runs are short, and a few are long."""
    out = rows[first]
    few = 6
    for r in range(1, few):
        on = np.flatnonzero((count > r) & (count <= few))
        if len(on):
            out[on] += rows[first[on] + r]
    for k in np.flatnonzero(count > few):
        run = rows[first[k] : first[k] + count[k]]
        out[k] = np.ones(len(run), np.float32) @ run
    return out


class Tokens:
    """The tokens of a block: every document's words and its end, with the contexts of each."""

    def __init__(self, block: Block, head: Head):
        n = block.n
        total = len(block.start) + n
        self.offsets = block.word_offsets + np.arange(n + 1)
        self.doc = np.repeat(np.arange(n), np.diff(self.offsets))
        h = np.full(total, _STOP)
        h[np.arange(len(block.start)) + block.doc] = word_keys(block)
        self.is_end = np.zeros(total, bool)
        self.is_end[self.offsets[1:] - 1] = True
        self.hash = h.view(np.int64)
        self.at, self.found = np.zeros(total, np.int64), np.zeros(total, bool)
        self.cls = np.full(total, TAIL, np.int64)
        if len(head.hashes):
            self.at = np.minimum(np.searchsorted(head.hashes, self.hash), len(head.hashes) - 1)
            self.found = (head.hashes[self.at] == self.hash) & ~self.is_end
            self.cls = np.where(self.found, head.classes[self.at], TAIL)
        self.cls[self.is_end] = END
        first = self.offsets[:-1]

        def before(x: np.ndarray, k: int, fill) -> np.ndarray:
            out = np.full(total, fill, x.dtype)
            out[k:] = x[:-k]
            for j in range(k):
                own = first + j
                out[own[own < self.offsets[1:]]] = fill
            return out

        one, two = (before(h, k, _BEGIN) * np.uint64(0x9E3779B97F4A7C15) for k in (1, 2))
        bits = lambda x, size: (x >> np.uint64(40)).astype(np.uint32) % np.uint32(size)
        pair = one + two * np.uint64(3)
        seen = before(self.cls, 1, CLASSES) * (CLASSES + 1) + before(self.cls, 2, CLASSES)
        self.class_features = [x.astype(np.uint16) for x in (bits(one, CLASS_SIZES[0]), bits(two, CLASS_SIZES[1]), bits(pair ^ pair >> np.uint64(29), CLASS_SIZES[2]), seen)]
        # the cell factor concerns the words of the head alone
        self.inside = np.flatnonzero(self.found)
        own = self.cls[self.inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.cell_features = [bits(mixed ^ mixed >> np.uint64(31), size).astype(np.uint16) for mixed, size in ((x[self.inside] + own, size) for x, size in zip((one, two), CELL_SIZES, strict=True))]
        self.cell_class = self.cls[self.inside]
        self.cell = head.cells[self.at[self.inside]] if len(head.hashes) else self.inside


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~hold_out(folds=7, fold=2))


def _count(docs: DataFrame) -> DataFrame:
    """(h, g, c, d): partial counts of each word in each group of documents; d documents (h null)."""

    def counted(parts: list[np.ndarray], n_docs: int) -> Iterator[pa.RecordBatch]:
        both, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        names = ["h", "g", "c", "d"]
        yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(6)).view(np.int64)), pa.array((both & np.uint64(63)).astype(np.int32)), pa.array(c.astype(np.int64)), pa.array(np.zeros(len(c), np.int64))], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([n_docs], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, n_docs = [], 0, 0
        for b in batches:
            for block in blocks(b.column(0)):
                h = word_keys(block)
                by = np.bincount(block.doc * _DOC_GROUPS + (h >> np.uint64(_HASH_BITS - 6)).astype(np.int64), minlength=block.n * _DOC_GROUPS)
                group = by.reshape(block.n, _DOC_GROUPS).argmax(1).astype(np.uint64)
                parts.append(h << np.uint64(6) | group[block.doc])
                held += len(h)
                n_docs += block.n
                if held >= COUNT_TOKENS:
                    yield from counted(parts, n_docs)
                    parts, held, n_docs = [], 0, 0
        yield from counted(parts, n_docs)

    return docs.select("text").mapInArrow(run, "h long, g int, c long, d long")


def _head(counts: DataFrame, size: int) -> Head:
    n_docs = counts.where("h is null").agg(F.sum("d")).first()[0] or 0
    words = counts.where("h is not null")
    # counts in steps of an eighth of a power of two: at most some hundred rows
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(((r[0], r[1], r[2]) for r in words.groupBy(level.alias("l")).agg(F.count("*"), F.sum("c")).collect()), reverse=True)
    types, tokens = sum(x[1] for x in levels), sum(x[2] for x in levels)
    least, taken = None, 0
    for lv, n, _ in levels:
        if taken + n > size:
            break
        least, taken = lv, taken + n
    top = words.where(level >= (least if least is not None else 1 << 20)).select("h", "c", "g").toPandas().sort_values("h")
    h, c, g = (top[k].to_numpy(np.int64) for k in ("h", "c", "g"))
    mass = np.bincount(g, c, _DOC_GROUPS)
    rank = np.empty(_DOC_GROUPS, np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(_DOC_GROUPS)
    group = np.minimum(rank[g], GROUPS - 1)
    classes, cells = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for k in range(GROUPS):
        own = np.flatnonzero(group == k)
        own = own[np.lexsort((h[own], -c[own]))]
        share = np.cumsum(c[own]) / max(1, c[own].sum())
        classes[own] = k * BINS + np.searchsorted(BIN_ENDS, share - 1e-12)
        for one in np.split(own, np.flatnonzero(np.diff(classes[own])) + 1):
            # near equal mass; as many words as there are cells, or fewer, get one each
            before = np.cumsum(c[one]) - c[one]
            cells[one] = np.arange(len(one)) if len(one) <= CELLS else np.minimum(before * CELLS // max(1, int(c[one].sum())), CELLS - 1)
    in_cell = np.bincount(classes * CELLS + cells, c, CLASSES * CELLS)
    logs = np.log(c / in_cell[classes * CELLS + cells]) if len(h) else np.empty(0)
    return Head(h, c, classes, cells, logs, n_docs, tokens + n_docs, types + (n_docs > 0), tokens - int(c.sum()), types - len(h))


def _train(docs: DataFrame, shared, factors: list[Factor], parts: int) -> list[Factor]:
    """One round: gradient steps in every part on its documents, then the weighted mean of the changes."""
    sent = docs.sparkSession.sparkContext.broadcast(factors)
    widths = [f.weights.shape[1] for f in factors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        part, now = None, []
        for b in batches:
            key = b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if first == end:
                    continue
                if key[first] != part:
                    yield from changed(part, now)
                    part, now = key[first], [f.trainable() for f in sent.value]
                for block in blocks(b.column(0).slice(first, end - first), BLOCK_BYTES):
                    t = Tokens(block, head)
                    now[0].train(t.class_features, t.cls)
                    now[1].train(t.cell_features, t.cell, t.cell_class)
        yield from changed(part, now)

    def changed(part: int, factors_: list[Factor]) -> Iterator[pa.RecordBatch]:
        for k, (now, old) in enumerate(zip(factors_, sent.value if factors_ else [], strict=True)):
            for p in range(0, len(now.steps), PIECE):
                steps = now.steps[p : p + PIECE]
                if steps.any():
                    d = (now.weights[p : p + PIECE] - old.weights[p : p + PIECE]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([p]), pa.array([part], pa.int64()), pa.array([d.tobytes()]), pa.array([steps.tobytes()])], ["factor", "piece", "part", "delta", "steps"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        width = widths[int(pdf["factor"].iloc[0])]
        n = len(pdf["steps"].iloc[0]) // 4
        total, count = np.zeros((n, width), np.float32), np.zeros(n, np.float32)
        pdf = pdf.sort_values("part")  # sums of rounded numbers depend on their order
        for d, s in zip(pdf["delta"], pdf["steps"], strict=True):
            s = np.frombuffer(s, np.float32)
            total += np.frombuffer(d, np.float16).reshape(n, width) * s[:, None]
            count += s
        total /= np.maximum(count, 1)[:, None]
        return pdf.head(1).assign(delta=[total.astype(np.float16).tobytes()], steps=[count.tobytes()])

    kind = "factor long, piece long, part long, delta binary, steps binary"
    # one change of the weights is sent for each part, however many partitions there are
    part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(parts)).alias("part")
    dealt = docs.select("doc_id", "text", part).repartition(parts, "part").sortWithinPartitions("part", "doc_id", "text")
    changes = dealt.select("text", "part").mapInArrow(run, kind)
    # in two levels, so that no group grows beyond the root of the number of parts
    fan = max(1, round(parts**0.5))
    once = changes.groupBy("factor", "piece", F.pmod("part", F.lit(fan)).alias("fan")).applyInPandas(lambda pdf: mean(pdf), kind)
    out = [Factor(f.weights.copy(), f.sizes, f.base) for f in factors]
    for r in once.groupBy("factor", "piece").applyInPandas(mean, kind).collect():
        delta = np.frombuffer(r["delta"], np.float16).reshape(-1, widths[r["factor"]])
        out[r["factor"]].weights[r["piece"] : r["piece"] + len(delta)] += delta
    sent.destroy()
    return out


def _score_head(docs: DataFrame, shared, factors: list[Factor]) -> DataFrame:
    """One row per document: what the broadcast part of the vocabulary can say, and the tail words that are left to look up."""
    sent = docs.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        of_class, of_cell = (f.work() for f in sent.value)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for block in blocks(b.column(1), BLOCK_BYTES):
                t = Tokens(block, head)
                lp = of_class.log_chances(t.class_features, t.cls)
                lp[t.inside] += of_cell.log_chances(t.cell_features, t.cell, t.cell_class)
                known = t.found | t.is_end & (head.docs > 0)
                base = np.full(len(lp), 0.0)
                if len(head.hashes):
                    lp += np.where(t.found, head.log_in_cell[t.at], 0)
                    base = np.where(t.found, head.base(head.counts[t.at]), 0)
                base = np.where(t.is_end, head.base(np.array(head.docs)), base)
                sums = [np.bincount(t.doc, v, block.n) for v in (known, base, lp / np.log(10))]
                rest = np.flatnonzero(~t.found & ~t.is_end)
                key = np.lexsort((t.hash[rest], t.doc[rest]))
                d, h = t.doc[rest][key], t.hash[rest][key]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                at = np.flatnonzero(new)
                many = np.diff(np.append(at, len(d))).astype(np.int32)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(d[at], minlength=block.n)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(block.n)), b.column(0).slice(block.first, block.n), pa.array(np.diff(t.offsets)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                        pa.ListArray.from_arrays(ends, pa.array(h[at])), pa.ListArray.from_arrays(ends, pa.array(many)),
                    ],
                    ["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail", "times"],
                )
                uid += block.n

    return docs.select("doc_id", "text").mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base_score double, score double, tail array<long>, times array<int>")


def score_documents(docs: DataFrame, head_words: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; training leaves out the held-out fold.

    Null and empty texts are one end token. Repeated rows give repeated results. Without training documents every token is
    unknown. Other columns are ignored; an empty table gives no rows.
    """
    train = _train_rows(bounded_batches(docs).select("doc_id", "text"))
    # the document total travels as a row without a word
    # one exchange serves both sums: what lies together by h lies together by (h, g)
    partial = _count(train).repartition("h").groupBy("h", "g").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    counts = spool(partial.groupBy("h").agg(F.max_by("g", F.struct("c", "g")).alias("g"), F.sum("c").alias("c"), F.sum("d").alias("d")), "word-counts")
    head = _head(counts, head_words)
    shared = docs.sparkSession.sparkContext.broadcast(head)
    factors = head.factors()
    parts = max(1, round(head.tokens / max(1, rounds) / PART_TOKENS))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rounds)))
    for r in range(rounds if head.docs else 0):
        factors = _train(train.where(turn == r), shared, factors, parts)
    scored = spool(_score_head(docs, shared, factors), "scored")
    shared.destroy()
    tail = scored.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("uid", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    seen = tail.join(counts.where("h is not null").select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    n = F.col("times")
    sums = seen.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, n).otherwise(0)).alias("more"),
        F.sum(n * F.log10((F.col("c") + 1) / F.lit(float(head.tokens + head.types + 1)))).alias("base"),
        F.sum(n * F.log10((F.col("c") + 1) / F.lit(float(head.tail_tokens + head.tail_types + 1)))).alias("own"),
    )
    out = scored.drop("tail", "times").join(sums, "uid", "left")
    return out.select(
        "doc_id",
        hold_out(folds=7, fold=2).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("own", F.lit(0.0))).alias("score"),
    )
