"""Helpers shared by the training-data operators: input tables, durable intermediate tables, connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by this process, removed when it ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


#: Rows of whole texts that pass to a Python worker at once; Spark's own 10,000 would hold a hundred times more than one block needs.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20

#: What this worker process keeps between tasks: (owner, key, value), of one operator at a time.
_kept: list[tuple] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after telling the session to pass BATCH_ROWS rows and about BATCH_BYTES at most to Python at once.

    Every operator on whole texts begins with it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def worker_state(owner: str, key, make: Callable):
    """In a task: make(), kept in this worker process for later tasks of the same owner and key. Anything else kept is dropped."""
    if not _kept or _kept[0][:2] != (owner, key):
        release_worker()
        _kept[:] = [(owner, key, make())]
    return _kept[0][2]


def release_worker() -> None:
    """In a task: drops what another operator has kept in this worker process, which outlives stages, and returns its memory."""
    if _kept:
        _kept.clear()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset: a local one in local mode (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before; the shared folder's owner clears it
            return


#: Bits of an id filter. 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(may, not): rows of df whose id may be among ids, and rows whose id certainly is not; all columns, no shuffle.

    ids has one column. A bitmap of hashed ids, of fixed size, is built by Spark and broadcast, so that a join on wide rows can be
    left to the first part. However many ids there are, both parts stay right; the first only grows. Null ids are never among ids.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at = bit(ids.columns[0]) + 1
    rows = ids.where(F.col(ids.columns[0]).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    size = len(rows[0]["bits"]) if rows else 4096
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        start = (r["bucket"] - 1) * size
        bitmap[start : start + size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    marked = df.select("*", F.when(F.col(id_col).isNotNull(), bit(id_col)).alias("_bit"))

    def side(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                last = b.num_columns - 1
                bits = b.column(last)
                pos = bits.fill_null(0).to_numpy(zero_copy_only=False)
                hit = ((shared.value[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).astype(bool) & bits.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(b.columns[:last], b.schema.names[:last]).filter(pa.array(hit == want))

        return run

    return marked.mapInArrow(side(True), df.schema), marked.mapInArrow(side(False), df.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edge list is written to the shared folder. A round moves at
    most one row per edge, and a node with many edges is met through joins and aggregates only, never as one list.
    Nodes may be of any ordered type. Edges with a null end and self-loops are ignored; an empty list gives no rows.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    e = spool(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "edges")
    old = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # large-star: every larger neighbour of u is linked to u's smallest neighbour (u included)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small-star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("x"), "m").unionByName(low.select(F.col("hi").alias("x"), "m"))
        nxt = spool(small.where("x <> m").select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        new = nxt.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        e = nxt
        if old == new or not new[0]:
            break
        old = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return stars.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
