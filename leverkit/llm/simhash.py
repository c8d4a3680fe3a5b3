"""Operator 11: SimHash near-duplicates by a byte-position inverted index with
count filtering.

A text's fingerprint has 64 bits, eight positional bytes.  Two fingerprints
that differ in at most d bits differ in at most d bytes, so they share at least
8 - d positional bytes: the guaranteed minimum.  An index on single bytes would
list a 256th of all fingerprints under each byte, so the index lists them under
``width`` positional bytes at once: of any d + width positions such a pair
shares at least ``width``, so the joint keys over the first d + width positions
meet every pair that can reach the minimum.  Where the fingerprints of a key
meet, the shared positional bytes of each pair are tallied, pairs below the
minimum are dropped, and the bits of the rest are counted.

``width`` follows the counted number of distinct fingerprints, so that the
lists of unrelated fingerprints stay short at every size; it changes the work,
never the pairs found.

Exact copies are one fingerprint.  A list of fingerprints that are all alike
yields a spanning forest of its links, not all of them, since only components
are asked for.  A key with more than BLOCK fingerprints is cut into blocks and
each two blocks meet in a place of their own, so no task holds a whole hot key.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import SPACE_WORDS, importable, saved, scan_words, small_or_plain, spaced_words, table, text_batches
from leverkit.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: fingerprints of one key that meet in one place; those of fewer than SMALL are paired by offsets
BLOCK = 4096
SMALL = 16
#: distinct fingerprints up to which two, and up to which three bytes make a key
WIDTHS = ((1 << 24, 2), (1 << 32, 3))
CELLS = 1 << 20


def shingle_spans(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, last word) of each shingle of rows whose words are
    ``first[i]:first[i + 1]``; fewer than k words are one shingle."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(len(n)), count)
    a = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, a, np.minimum(a + k, first[1:][row]) - 1


def _votes(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Majority of each bit over the hashes of each row; ``row`` ascends."""
    out = np.zeros(rows, np.uint64)
    if len(h):
        u, first, n = np.unique(row, return_index=True, return_counts=True)
        for b in range(64):
            ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), first)
            out[u] |= (2 * ones > n).astype(np.uint64) << np.uint64(b)
    return out


def _fingerprints(k: int):
    def run(batches):
        for b in batches:
            got = [np.zeros(0, np.uint64)]
            for c in scan_words(b.column("text"), SPACE_WORDS):
                buf, start, end = spaced_words(c)
                row, i, j = shingle_spans(c.first, k)
                digest = xxhash.xxh64_intdigest
                h = np.fromiter((digest(buf[x:y], SEED) for x, y in zip(start[i].tolist(), end[j].tolist(), strict=True)), np.uint64, len(row))
                got.append(_votes(h, row, c.hi - c.lo))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(got).view(np.int64))], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint read as a signed long."""
    spark = docs.sparkSession
    importable(spark)
    text_batches(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


# ---------------------------------------------------------------- links

def key_width(n: int, distance: int) -> int:
    return min(8 - distance, next((w for most, w in WIDTHS if n <= most), 4))


def _keys(width: int, distance: int):
    """Joint keys: ``width`` of the first ``distance + width`` positional bytes."""
    def byte(i):
        return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    out = []
    for c, places in enumerate(combinations(range(distance + width), width)):
        key = F.lit(c).cast("long")
        for i in places:
            key = key * 256 + byte(i)
        out.append(key)
    return F.explode(F.array(*out)).alias("key")


def linked(x: np.ndarray, distance: int) -> np.ndarray:
    """Which XORs of two fingerprints have enough equal positional bytes
    (tallied) and then few enough differing bits."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    differ = ((((x & low) + low) | x) & ~low)  # the top bit of each byte that is not zero
    enough = 8 - np.bitwise_count(differ) >= 8 - distance
    enough[enough] = np.bitwise_count(x[enough]) <= distance
    return enough


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable after adding the edges (a, b) to the forest."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what the links among ``fp`` connect."""
    n = len(fp)
    label, step = np.arange(n), max(1, CELLS // n)
    for lo in range(0, n - 1, step):
        rows = fp[lo:lo + step]
        a, b = np.nonzero(linked(rows[:, None] ^ fp[None, lo:], distance))
        label = _join_labels(label, a + lo, b + lo)
    up = np.flatnonzero(label != np.arange(n))
    return fp[up], fp[label[up]]


def group_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``; large runs give a forest."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size = np.diff(cut)
    out = [(np.zeros(0, np.uint64),) * 2]
    small = np.repeat(size < SMALL, size)
    g, f = group[small], fp[small]
    for k in range(1, SMALL):
        at = np.flatnonzero(g[k:] == g[:-k])
        if not len(at):
            break
        at = at[linked(f[at] ^ f[at + k], distance)]
        out.append((f[at], f[at + k]))
    for i in np.flatnonzero(size >= SMALL):
        out.append(forest(fp[cut[i]:cut[i + 1]], distance))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _links(distance: int):
    """Rows come sorted by group; the last group of a batch waits for the next."""
    def run(batches):
        def give(g, f):
            a, b = group_links(g, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        wait = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.concatenate([wait[0], np.column_stack([np.array(batch.column(c), np.int64) for c in ("key", "x", "y")])])
            f = np.concatenate([wait[1], np.array(batch.column("fp"), np.int64).view(np.uint64)])
            change = np.concatenate([[0], (g[1:] != g[:-1]).any(1).cumsum()])
            last = int(np.searchsorted(change, change[-1]))
            if last:
                yield give(change[:last], f[:last])
            wait = g[last:], f[last:]
        if len(wait[1]):
            yield give(np.zeros(len(wait[1]), np.int64), wait[1])
    return run


def links(fps: DataFrame, n: int, distance: int = DISTANCE, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """(a, b): edges that connect what the links among the ``n`` distinct
    fingerprints ``fps`` (column fp) connect."""
    width = width or key_width(n, distance)
    keys = fps.select("fp", _keys(width, distance))
    met = keys.withColumns({"x": F.lit(0), "y": F.lit(0)})
    hot = saved(keys.groupBy("key").count().where(F.col("count") > block)
                .select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hotkeys")
    if hot.take(1):
        hot = small_or_plain(hot, 16)
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cut = (keys.join(hot, "key").withColumn("own", own).withColumn("other", other)
               .select("fp", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
        met = keys.join(hot, "key", "left_anti").select("fp", "key", F.lit(-1).alias("x"), F.lit(-1).alias("y")).unionByName(cut)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (met.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
            .mapInArrow(_links(distance), "a long, b long"))


FP_A_FILE = 200_000


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK,
                       width: int | None = None) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id reachable over fingerprints that differ in at most
    ``distance`` bits, at most 6; its own included).

    Defined cases: null, empty and word-free texts have the fingerprint zero
    and link like any other; a text of fewer words than a shingle is one
    shingle; repeated rows each get a row; a null doc_id takes part and counts
    only if no other id is in its component; texts of any length are used
    whole; an empty table gives no rows; further columns are not looked at.
    """
    if not 0 <= distance <= 6:
        raise ValueError("distance must be 0 to 6: beyond it two fingerprints need not share two bytes")
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    n = classes.count()
    found = links(classes.select("fp"), n, distance, block, width)
    parts = 1 + n // FP_A_FILE
    labels = components(found, parts=parts).withColumnRenamed("node", "fp")
    classes = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = saved(classes, "labelled", parts)
    lows = classes.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("c")).where("c > 1")
    classes = (classes.join(lows.drop("c"), "label", "left")
               .select("fp", F.when(F.col("component_id").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id")))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
