"""Helpers shared by the training-data operators.

* ``saved`` writes an intermediate once to the cluster-shared folder
  (``spark.checkpoint.dir``) and reads it back, so lineage is cut and a lost
  executor re-reads files instead of recomputing scans.
* ``scan_words`` finds and hashes the words of a whole Arrow text column with
  numpy, a bounded chunk of bytes at a time.  It works on UTF-8 bytes: every
  separator of the two word definitions in use is an ASCII character and every
  byte of a non-ASCII character is above 0x7F, so byte and character
  definitions agree.
* ``prefix_sum`` is a distributed running sum over a range-sorted frame.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leverkit.session import importable, shared_dir

#: a chunk's arrays take about 50 times its bytes in each Python worker
CHUNK_BYTES = 1 << 18
#: a sum of powers modulo 2^64 cannot tell some words of 1,024 bytes and more
#: apart, whatever its base; longer words than this get a hash of another kind
LONG_WORD = 255
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str = "t", parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written copy, in at
    most ``parts`` files: a table far smaller than the shuffle before it would
    otherwise become very many tiny ones."""
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries in this block go when each query ends; by
    default they stay until the driver happens to collect its garbage, so those
    of all steps lie on the executors' disks together."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows of an Arrow batch of texts.  Spark's default of 10,000 is meant for
    narrow rows; texts of a few kilobytes make batches of tens of megabytes,
    held several times over by the JVM and the Python worker."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


# ---------------------------------------------------------------- words

def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()


def _class(*spans: tuple[int, int]) -> np.ndarray:
    """Byte class: True for word bytes, False inside the given spans."""
    t = np.ones(256, dtype=bool)
    for a, b in spans:
        t[a:b + 1] = False
    return t


#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM_WORDS = _class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: words [^\x20\x09-\x0D]+
SPACE_WORDS = _class((0x20, 0x20), (0x09, 0x0D))

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        one = np.ones(1, np.uint64)
        _powers[:] = [np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))])
                      for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public murmur3 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


@dataclass
class Chunk:
    """Words of rows ``lo:hi`` of a column.

    ``first[i]:first[i + 1]`` are the words of row ``lo + i``; word j is
    ``data[start[j]:end[j]]`` with 64-bit hash ``hash[j]``.
    """
    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> str:
        """Words a..b-1 joined by one space."""
        d = self.data
        return b" ".join(d[self.start[j]:self.end[j]].tobytes() for j in range(a, b)).decode("utf-8", "replace")


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null row has length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    return offs, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together (one row at least)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def scan_words(col: pa.Array, words: np.ndarray, limit: int = CHUNK_BYTES, lower: bool = True) -> Iterator[Chunk]:
    """Lower-case A-Z (if ``lower``) and cut every row of ``col`` into words of
    the byte class ``words``; whole texts, whatever their length."""
    offs, data = text_buffers(col)
    for lo, hi in row_chunks(offs, limit):
        cut = offs[lo:hi + 1] - offs[lo]
        d = data[offs[lo]:offs[hi]]
        d = LOWER[d] if lower else d
        inside = words[d]
        prev = np.empty(len(d), bool)
        if len(d):
            prev[0] = False
            prev[1:] = inside[:-1]
            prev[cut[:-1][cut[:-1] < len(d)]] = False
        start = np.flatnonzero(inside & ~prev)
        nxt = np.ones(len(d), bool)
        if len(d):
            nxt[:-1] = ~inside[1:]
            ends_at = cut[1:][cut[1:] > 0] - 1
            nxt[ends_at] = True
        end = np.flatnonzero(inside & nxt) + 1
        up, down = _power_tables(len(d) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(_BYTE[d] * up[:len(d)], out=run[1:])
            h = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
        for j in np.flatnonzero(end - start > LONG_WORD):
            h[j] = xxhash.xxh64_intdigest(d[start[j]:end[j]].tobytes(), LONG_WORD)
        yield Chunk(lo, hi, d, start, end, h, np.searchsorted(start, cut))


def spaced_words(c: Chunk) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a chunk joined by one space, and where each begins and
    ends: words i to j of one row are ``out[start[i]:end[j]]``."""
    size = c.end - c.start
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(word))
    out[k + word] = c.data[k - np.repeat(at - np.arange(len(size)) - c.start, size)]
    return out.tobytes(), at, at + size


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _STEP[0]
        for i in range(1, k):
            out = mix(out + _STEP[1]) + h[i:i + n] * _STEP[2]
        return mix(out + np.uint64(k))


def text_key(col: str | Column = "text") -> Column:
    """128-bit content key of a text; null and empty text differ."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), c), F.lit("n"))))


# ---------------------------------------------------------------- running sums

def prefix_sum(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int | None = None,
               name: str = "prefix") -> DataFrame:
    """Exclusive running sums in the total order ``order``; ``sums`` maps a
    value column to the name of its running sum.

    The rows are range-sorted into partitions and written; the total of each
    partition is turned into an offset over one row per partition; inside a
    partition a window adds up.  No task sees more than its range and a key
    that holds a third of the rows is spread over many ranges, as long as
    ``order`` is a total order (ties share a range).  The sums are integers or
    decimals, so they do not depend on the number of ranges.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = saved(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), name)
    # one row per range: bounded by the number of partitions, not by the rows
    ends = ordered.groupBy("__p").agg(*[F.sum(v).alias(f"__t_{v}") for v in sums])
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("__p", *[F.coalesce(F.sum(f"__t_{v}").over(upto), F.lit(0)).alias(f"__b_{v}") for v in sums])
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ordered.join(F.broadcast(before), "__p")
            .withColumns({o: F.col(f"__b_{v}") + F.sum(v).over(w) - F.col(v) for v, o in sums.items()})
            .drop("__p", *[f"__b_{v}" for v in sums]))


BROADCAST_BYTES = 32 << 20


def small_or_plain(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written frame for broadcast if its counted rows, at ``row_bytes``
    each, fit in ``limit``; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
