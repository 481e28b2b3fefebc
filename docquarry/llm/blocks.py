"""Whole-column text kernels and fixed-size aggregates shared by the operators.

The operators look at every word of every document.  Rather than exploding words
into rows, a task receives Arrow batches and treats the UTF-8 bytes of the text
column as one numpy array: words are found and hashed with a handful of
vectorised passes over the bytes, in slices of about a megabyte so that memory
does not depend on the batch (one longer document forms a slice of its own).

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters, compared without regard to ASCII and Latin-1 letter case.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

FOLD = np.zeros(256, np.uint8)
FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + 1)
        p, q = np.full(size, _BASE), np.full(size, _BASE_INV)
        p[0] = q[0] = 1
        with np.errstate(over="ignore"):
            _pow, _inv = np.cumprod(p), np.cumprod(q)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, so that low and high bits are equally good."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of documents: hashes, byte ranges, and where each document's begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # documents + 1, into hashes

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of data (uint8); document d is data[bounds[d]:bounds[d + 1]], bounds[0] being 0."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64))
    low = FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    low[lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1] += 0x20
    inside = low != 0
    cut = bounds[(bounds > 0) & (bounds < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut] = False
    follows = np.empty(n, bool)
    follows[-1] = False
    follows[:-1] = inside[1:]
    follows[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~follows) + 1
    p, q = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(low * p[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * q[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most that many bytes together, or one document."""
    n, a = len(bounds) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def worded(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(first, last + 1, bytes, bounds, words) of each slice of a text column."""
    data, bounds = texts_of(column)
    for a, b in slices(bounds):
        part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        yield a, b, part, own, words(part, own)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word n-grams, in order, and offsets of documents.

    A document of fewer than n words, but at least one, has one: all its words.
    """
    count = np.diff(w.offsets)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(w.offsets[:-1] - offsets[:-1], size) + np.arange(offsets[-1])
    last = np.repeat(w.offsets[1:], size)
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            at = first + k
            x = w.hashes[np.minimum(at, len(w.hashes) - 1)] if len(w.hashes) else h
            h = h * np.uint64(0x9FB21C651E98DF25) + np.where(at < last, x, np.uint64(k + 1))
    return mix(h), offsets


def hash_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return words(data, np.array([0, len(data)])).hashes


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set here if that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        where = f"file:///tmp/docquarry-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone; the folder is scratch
            pass


def scratch(spark: SparkSession, what: str) -> str:
    """A path for a new table in the shared folder, removed when Python exits."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_quiet_remove, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, removed when Python exits."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts that no frame uses any more; else they stay until the JVM collects garbage."""
    jvm = spark.sparkContext._jvm
    for _ in range(2 if jvm is not None else 0):  # what the first round lets go of may hold more
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)  # Spark deletes in the background


def partition_id() -> int:
    return TaskContext.get().partitionId()


def sum_arrays(df: DataFrame, make, dtype: str, blocks: int, fan: int = 16) -> list[np.ndarray]:
    """Sums arrays over all tasks; returns one per block.

    make(batches) yields (block, array) per task, arrays of one block all being of
    one fixed length.  They are added up in a tree: no step reads more than fan arrays of a block, however many tasks
    there are.
    """
    kind = np.dtype(dtype)
    schema = "block int, part int, data binary"

    def first(batches):
        out = list(make(batches))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([partition_id() // fan] * len(out), pa.int32()), pa.array([np.ascontiguousarray(a, kind).tobytes() for _, a in out], pa.binary())], names=["block", "part", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("data"):
            a = np.frombuffer(x.as_buffer(), kind)
            total = a.copy() if total is None else np.add(total, a, out=total)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("part")[0].as_py() // fan], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    sums, parts = df.mapInArrow(first, schema), -(-df.rdd.getNumPartitions() // fan)
    while True:
        sums = sums.groupBy("block", "part").applyInArrow(add, schema)
        if parts <= 1:
            break
        parts = -(-parts // fan)
    got: dict[int, np.ndarray] = {}
    for r in sums.collect():  # one row a block
        a = np.frombuffer(bytes(r["data"]), kind)
        got[r["block"]] = got[r["block"]] + a if r["block"] in got else a
    return [got.get(b) for b in range(blocks)]


def scanned(documents: DataFrame) -> DataFrame:
    """documents, whose rows keep their order when a task is repeated: as they are if they come from a scan, else written."""
    plan = documents._jdf.queryExecution().executedPlan().toString()
    return written(documents, "documents") if "Exchange" in plan else documents


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that the scan reads no others; doc_id as a long."""
    return docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in columns])
