"""Best-fit packing of whole documents into training sequences by large-item matching.

A document longer than a sequence is cut into whole sequences, of which the first may be shorter; no other is cut. Then:

1. Count the pieces of each length. A length is at most the capacity, so the counts are a bounded table however many pieces there are,
   and what follows is done once for each length, not for each piece.
2. Large pieces, longer than a third of the capacity, of which no three fit: from the longest down, each is matched with the
   longest large piece that still fits beside it, so that a sequence holds two at most.
3. Small pieces, from the longest down, go where they fit best: into the sequence with the smallest gap that takes them. Where none
   does, they open a new one. Equal pieces that meet equal gaps are placed as one step.
4. The steps say: pieces number a to b of this length lie in those sequences, so many in each, from this place on. Workers number the
   pieces of each length, in groups of bounded size and by a prefix sum over the groups, and look their step up.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import broadcast_vocabulary, byte_symbols
from .common import bounded_batches, spool, worker_state

CAPACITY = 2048
#: Rows of one numbering group, about.
GROUP_ROWS = 2_000
#: Chunks whose ids a worker keeps, in each of two generations, and the longest chunk kept.
CACHE_CHUNKS, CACHED_CHARS = 400_000, 64

#: Places where a text may be cut: before a single blank between two other characters.
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


class ChunkEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, with those of frequent chunks kept.

    The file's word split puts a border before every single blank between two other characters, so texts are cut there, the different
    chunks of a batch are looked up, and those not known are encoded as one text, whose ids are dealt back by their lengths in bytes.
    A text with special tokens is left to the library as a whole, one with blanks beside other white space is cut where that is safe.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        spec = json.loads(content)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("the tokenizer file must split words as byte-level BPE does, without normaliser or prefix blank")
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size_of[i] = len(t)
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk; every chunk but the first begins with a blank and all stand apart when joined."""
        if not chunks:
            return []
        raw = [c.encode() for c in chunks]
        ids = np.array(self.fast.encode_ordinary("".join(chunks)), "<u4")
        ends = np.searchsorted(np.cumsum(self.size_of[ids]), np.cumsum([len(r) for r in raw]), side="right")
        packed = ids.tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _whole(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self._joined(_SAFE_CUT.split(text)))

    def _look_up(self, parts: list[str]) -> list[bytes | None]:
        """The ids of a blank and each part; None for a part that is empty or has white space at an end, where no cut is safe."""
        if len(self.young) > CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        known, older = self.young, self.old
        out = list(map(known.get, parts))
        missing = []
        for k, ids in enumerate(out):
            if ids is None:
                part = parts[k]
                ids = older.get(part)
                if ids is not None:
                    known[part] = out[k] = ids
                elif part and part == part.strip():
                    missing.append(k)
        for k, ids in zip(missing, self._joined([" " + parts[k] for k in missing]), strict=True):
            out[k] = ids
            if len(parts[k]) <= CACHED_CHARS:
                known[parts[k]] = ids
        return out

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a string column, as little-endian unsigned 32-bit numbers; null counts as empty."""
        column = column.fill_null("")
        split = pc.split_pattern(column, " ")
        coded = split.flatten().dictionary_encode()
        parts, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        found = self._look_up(parts)
        # a text's first part has no blank before it and stands after the known parts
        firsts = [parts[c] for c in codes[at[:-1]]]
        codes[at[:-1]] = len(parts) + np.arange(len(firsts))
        found += [None if f != f.strip() else (np.array(self.fast.encode_ordinary(f), "<u4").tobytes() if f else b"") for f in firsts]
        unsafe = np.array([x is None for x in found])
        apart = np.logical_or.reduceat(unsafe[codes], at[:-1]) if len(firsts) else np.zeros(0, bool)
        if self.special:
            apart |= np.array([bool(self.special.search(t)) for t in column.to_pylist()], bool) if self._may_be_special(column) else False
        sizes = np.array([len(x) // 4 if x is not None else 0 for x in found], np.int64)
        ids = np.frombuffer(b"".join([x for x in found if x is not None]), "<u4")
        begin = np.cumsum(sizes) - sizes
        n = sizes[codes]
        end = np.cumsum(n)
        packed = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(begin[codes] - (end - n), n)].tobytes()
        border = np.concatenate(([0], end))[at].tolist()
        return [self._whole(column[k].as_py()) if apart[k] else packed[4 * border[k] : 4 * border[k + 1]] for k in range(len(column))]

    def _may_be_special(self, column: pa.Array) -> bool:
        return pc.any(pc.match_substring_regex(column, self.special.pattern)).as_py() is True


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: whole sequences, of which the first may be shorter."""
    whole, rest = divmod(tokens, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


def _cut(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    shared = broadcast_vocabulary(bounded_batches(docs), path)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = shared.value
        encoder = worker_state("byte-bpe", hashlib.md5(content.encode()).digest(), lambda: ChunkEncoder(content))
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.encode(b.column(1))):
                packed, s = memoryview(ids + end), 0
                for p, size in enumerate(piece_lengths(len(packed) // 4, capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(packed[4 * s : 4 * (s + size)]))
                    s += size
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, n, per, sequence, offset): pieces first to first + n - 1 of a length lie per in a sequence, from that place.

    counts: pieces of each length. The work and the steps depend on the number of lengths and of gaps, not on the pieces.
    """
    left, steps = dict(counts), []
    placed = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    open_gaps: list[int] = []
    opened = 0

    def put(size: int, n: int, per: int, sequence: int, offset: int) -> None:
        steps.append((size, placed[size], n, per, sequence, offset))
        placed[size] += n
        left[size] -= n

    def leave(gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, sequences))

    large = sorted(s for s in counts if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            beside = next((t for t in reversed(large[: bisect.bisect_right(large, min(size, capacity - size))]) if left[t] > (t == size)), None)
            if beside is None:
                n = left[size]
                put(size, n, 1, opened, 0)
                leave(capacity - size, opened, n)
            elif beside == size:
                n = left[size] // 2
                put(size, 2 * n, 2, opened, 0)
                leave(capacity - 2 * size, opened, n)
            else:
                n = min(left[size], left[beside])
                put(size, n, 1, opened, 0)
                put(beside, n, 1, opened, size)
                leave(capacity - size - beside, opened, n)
            opened += n
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect.bisect_left(open_gaps, size)
            if k == len(open_gaps):
                n = -(-left[size] * size // (capacity // size * size))
                first, gap = opened, capacity
                opened += n
            else:
                gap = open_gaps[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[k]
            per = gap // size
            full = min(n, left[size] // per)
            if full:
                put(size, full * per, per, first, capacity - gap)
                leave(gap - per * size, first, full)
            rest = min(left[size], per - 1) if full < n else 0
            if rest:
                put(size, rest, rest, first + full, capacity - gap)
                leave(gap - rest * size, first + full, 1)
            leave(gap, first + full + (rest > 0), n - full - (rest > 0))
    return steps


def pack_whole(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A null text is an empty one and gives the end token alone. Repeated rows are packed once each; among equal lengths the order of
    ids decides. Null ids are packed like others. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = spool(_cut(docs, tokenizer_path, end_id, capacity), "whole-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if not counts:
        return spark.createDataFrame([], pieces.schema.add("sequence_id", "long").add("offset", "long"))
    # a length with many pieces is numbered in many groups, by the hash of the row
    groups = spark.createDataFrame([(size, -(-n // GROUP_ROWS)) for size, n in counts.items()], "length long, groups long")
    keyed = pieces.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "groups"))
    per_part = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("in_part", rank).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("in_part"))
    steps = spark.createDataFrame(plan_sequences(counts, capacity), "length long, first long, n long, per long, sequence long, place long")
    j = ranked.join(F.broadcast(steps), (ranked["length"] == steps["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    nth = F.col("rank") - F.col("first")
    turn = F.floor(nth / F.col("per"))
    return j.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + turn).alias("sequence_id"), (F.col("place") + (nth - turn * F.col("per")) * ranked["length"]).alias("offset"))
