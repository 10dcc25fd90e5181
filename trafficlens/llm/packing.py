"""Packing of tokenised documents into fixed-length training sequences: harmonic classes with exact piece lengths.

A document of n tokens gives n // capacity whole sequences. What is left is cut, largest piece first, into lengths that are
exactly floor(capacity / i) for some i <= 64; the last rest of at most 64 tokens is a piece of its own. So every piece of class i
has capacity/(i+1) < length <= capacity/i, all pieces of a class have one length, and i of them fill a sequence up to at most
i - 1 tokens. Rests shorter than capacity / 64 fill strips of an eighth of a sequence, each with as many rests of one length as fit,
and eight strips make a sequence. Workers rank their pieces within a class independently; counts of the ranks' groups give global
ranks by a prefix sum, and rank // i is the sequence (or strip). What fills none is at most i - 1 pieces of each class, a number that
does not grow with the data: 2,016 pieces for i <= 64 and at most 2,360 short rests at a capacity of 4096. Those are packed
first-fit-decreasing into the last sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import broadcast_vocabulary, worker_encoder
from .common import bounded_batches, spool

CAPACITY = 4096
FINEST = 64
STRIPS = 8  # in a sequence
#: Rows of one ranking group, about.
GROUP_ROWS = 50_000


def cut_lengths(tokens: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document with so many tokens, in order."""
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest > capacity // finest:
        i = -(-capacity // rest)
        if i > finest:
            break
        size = capacity // i
        out.append((size, i))
        rest -= size
    if rest:
        out.append((rest, capacity // rest))
    return out


def _cut(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    shared = broadcast_vocabulary(bounded_batches(docs), path)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids_of = b.column(0).slice(at, 512)
                row, start, length, crc, total, kind = [], [], [], [], [], []
                for k, t in enumerate(b.column(1).slice(at, 512)):
                    packed = memoryview(enc.encode(t.as_py()) + end)
                    n, s = len(packed) // 4, 0
                    for size, i in cut_lengths(n, capacity):
                        row.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(packed[4 * s : 4 * (s + size)]))
                        total.append(n)
                        kind.append(i if i <= FINEST else -size)
                        s += size
                yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, kind))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class long")


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        space: list[int] = []
        where, offset = [], []
        for size in rows["length"]:
            k = next((k for k, s in enumerate(space) if s >= size), len(space))
            if k == len(space):
                space.append(capacity)
            where.append(k)
            offset.append(capacity - space[k])
            space[k] -= size
        return rows.assign(sequence_id=rows["first_free"] + np.array(where, np.int64), offset=np.array(offset, np.int64)).drop(columns="first_free")

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece; each token lies in one piece.

    A null text is an empty one and gives the end token alone. Repeated rows are packed once each. Other columns are ignored.
    An empty table gives no rows.
    """
    pieces = spool(_cut(docs, tokenizer_path, end_id, capacity), "pieces")
    groups = max(1, pieces.count() // GROUP_ROWS)
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    per_part = keyed.groupBy("class", "part").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("class")
    parts = per_part.select("class", "part", (F.sum("n").over(by_class.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by_class).alias("n_class"))
    # at most FINEST + capacity / FINEST classes, whatever the data; a negative class is that of strips of rests of such a length
    strip = F.col("class") < 0
    per = F.when(strip, F.floor(capacity // STRIPS / -F.col("class"))).otherwise(F.col("class"))
    full = per_part.groupBy("class").agg(F.sum("n").alias("n")).select("class", per.alias("per"), F.floor(F.col("n") / per).alias("full"))
    earlier = Window.partitionBy(strip).orderBy("class")
    bases = full.select("class", "per", "full", (F.sum("full").over(earlier) - F.col("full")).alias("base"))
    totals = full.agg(F.coalesce(F.sum(F.when(~strip, F.col("full"))), F.lit(0)).alias("whole"), F.coalesce(F.sum(F.when(strip, F.col("full"))), F.lit(0)).alias("strips"))
    bases = bases.crossJoin(F.broadcast(totals)).select("class", "per", "full", "base", "whole", (F.col("whole") + F.ceil(F.col("strips") / STRIPS)).alias("first_free"))
    place = parts.join(F.broadcast(bases), "class")
    in_part = Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("rn", F.row_number().over(in_part) - 1).join(place, ["class", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rn")).withColumn("bin", F.floor(F.col("rank") / F.col("per")))
    full = F.col("bin") < F.col("full")
    number = F.col("base") + F.col("bin")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = ranked.where(full & ~strip).withColumn("sequence_id", number).withColumn("offset", (F.col("rank") - F.col("bin") * F.col("per")) * F.col("length"))
    # strips of a sequence may hold rests of different lengths, so their offsets are summed there
    strips = ranked.where(full & strip).withColumn("sequence_id", F.col("whole") + F.floor(number / STRIPS))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1))
    packed = packed.select(*out).unionByName(strips.withColumn("offset", F.coalesce(before, F.lit(0))).select(*out))
    rest = ranked.where(~full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "first_free")
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = rest.groupBy("first_free").applyInPandas(_first_fit(capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.unionByName(last.select(*out))
