"""Histogram sort into shards of near-equal bytes.

Rows are ordered by (hash of the text, hash of the id): copies of one text lie side by side. Shard borders are found by counting:
each round counts the exact bytes between evenly spaced probes within the intervals that still hold a border, and narrows each
interval to the cell its target falls in, until the bytes below a border are within the tolerance or the cell holds one text. A group
of equal texts that a border falls into stays whole, the border moving to its nearer edge, unless the group is larger than
GROUP_SHARE of a shard and than the largest row; only then the border is sought among its rows. Then one exchange puts rows in place.
Only probe counts (at most PROBES for each border and round) reach the driver. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

PROBES = 128
#: A border may miss its target by this share of a shard.
TOLERANCE = 0.0005
#: A group of equal texts up to this share of a shard is never split; a border misses its target by half of that at most.
GROUP_SHARE = 0.05
TOP = 1 << 63
#: Rows of one numbering group, about.
GROUP_ROWS = 20_000


@dataclass
class _Border:
    target: float
    lo: int = 0  # interval of the first key part that holds the border, later of the second part
    hi: int = TOP
    below: int = 0  # exact bytes below lo
    first: int | None = None  # the first part, once it is one value
    at: tuple[int, int] | None = None  # the border: keys below it go to lower shards

    @property
    def interval(self) -> tuple:
        return (self.first, self.lo, self.hi, self.below)

    @property
    def step(self) -> int:
        return -(-(self.hi - self.lo) // PROBES)

    def edge(self, cell: int) -> tuple[int, int]:
        k = min(self.lo + cell * self.step, self.hi)
        return (k, 0) if self.first is None else (self.first, k)

    def narrow(self, counts: dict[int, tuple[int, int]], slack: float, whole: float) -> None:
        """counts: bytes and rows of each cell of the interval. Groups of equal texts of up to whole bytes are not split."""
        below = self.below
        for cell in sorted(counts):
            size, rows = counts[cell]
            if below + size < self.target:
                below += size
                continue
            under, over = self.target - below, below + size - self.target
            one_text = self.step == 1 and (self.first is not None or size <= whole)
            if min(under, over) <= slack or rows == 1 or one_text:
                self.at = self.edge(cell) if under <= over else self.edge(cell + 1)
            elif self.step == 1:
                self.first, self.lo, self.hi, self.below = self.lo + cell, 0, TOP, below
            else:
                lo = self.lo + cell * self.step
                self.lo, self.hi, self.below = lo, min(lo + self.step, self.hi), below
            return
        self.at = self.edge(max(counts, default=0) + 1)


def _borders(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    total, largest = (x or 0 for x in keyed.agg(F.sum("size"), F.max("size")).first())
    whole = max(GROUP_SHARE * total / shards, largest)
    borders = [_Border(total * i / shards) for i in range(1, shards)]
    while open_ := [b for b in borders if b.at is None]:
        intervals = {b.interval: b for b in open_}
        cell: Column = F.lit(None).cast("long")
        for j, b in enumerate(intervals.values()):
            part = "h" if b.first is None else "d"
            within = F.col(part).between(b.lo, b.hi - 1)
            if b.first is not None:
                within &= F.col("h") == b.first
            cell = F.when(within, F.expr(f"({part} - {b.lo}L) div {b.step}L") + j * PROBES).otherwise(cell)
        got = keyed.select(cell.alias("cell"), "size").where("cell is not null").groupBy("cell").agg(F.sum("size"), F.count("*")).collect()
        counts: list[dict[int, tuple[int, int]]] = [{} for _ in intervals]
        for c, size, rows in got:
            counts[c // PROBES][c % PROBES] = (size, rows)
        for b in open_:
            b.narrow(counts[list(intervals).index(b.interval)], tolerance * total / shards, whole)
    return [b.at for b in borders]


def shard_by_bytes(docs: DataFrame, shards: int = 40, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row: shards of near-equal size, slots gapless from 0.

    size is the text's UTF-8 bytes (none for null) plus 16. Repeated rows keep a row each. A row larger than a shard's
    share makes its shard as much larger; some rows beside it may lie there too. Shards may be empty where there are fewer keys than shards. An empty table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(
        docs["doc_id"],
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("h"),
        F.shiftrightunsigned(F.xxhash64(docs["doc_id"]), 1).alias("d"),
    )
    keyed = spool(keyed, "shard-keys")
    shard: Column = F.lit(0)
    for h, d in _borders(keyed, shards, tolerance):
        past = F.col("h") > h if h < TOP else F.lit(False)
        if h < TOP:
            past |= (F.col("h") == h) & (F.col("d") >= d) if d < TOP else F.lit(False)
        shard = shard + past.cast("int")
    groups = max(1, keyed.count() // (shards * GROUP_ROWS))
    placed = keyed.withColumn("shard", shard).withColumn("part", F.pmod(F.col("d"), F.lit(groups)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "d", "doc_id", "size")) - 1
    return placed.withColumn("rank", rank).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
