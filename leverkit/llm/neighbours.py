"""Operator 10: approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: vectors are divided by the
largest norm and get one more component that brings each to length one;
queries are scaled to length one with that component 0.  A table hashes a
vector with HASHES Gaussian projections, floor((a.v + b) / w) each.  A query
visits its own bucket and then perturbed ones (each projection moved by -1, 0
or +1) in order of estimated success: the expected sum of squared distances to
the walls that are crossed.  What all tables give is merged and ranked by the
exact inner product.

Spark deals vectors and probes out by (table, bucket).  A bucket is cut into
blocks of bounded size on both sides, so that neither a vector that very many
rows resemble nor a popular query region lands in one task; a block of vectors
meets a block of queries in one matrix product and returns the nearest of each
query.  Every row is indexed and no bucket is capped.

The width of the buckets is fitted on a bounded sample (FIT_ROWS) and the
number of probes on a bounded number of queries (FIT_QUERIES) whose true
neighbours among all rows are found first: the least number with which the
tables find TARGET of them.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leverkit.llm.common import importable, saved, small_or_plain, table

HASHES = 8
TABLES = 3
FIT_ROWS = 4096
FIT_QUERIES = 128
TARGET = 0.96
#: rows per bucket aimed at: this times the square root of all rows, so that
#: buckets and rows per bucket grow alike; and rows a block may have on either side
BUCKET_FACTOR = 4.0
BLOCK_ROWS = 4096


def probe_templates(hashes: int) -> np.ndarray:
    """All perturbation sets over the 2 * hashes walls, ranked by distance, in
    order of the expected sum of squared distances (walls j and 2h - 1 - j are
    the two of one projection, so a set has one of them at most)."""
    h = hashes
    j = np.arange(1, h + 1)
    near = j * (j + 1) / (4 * (h + 1) * (h + 2))
    k = 2 * h + 1 - np.arange(h + 1, 2 * h + 1)
    far = 1 - k / (h + 1) + k * (k + 1) / (4 * (h + 1) * (h + 2))
    cost = np.concatenate([near, far])
    sets = np.zeros((3 ** h, 2 * h), np.int8)
    for row, pick in enumerate(itertools.product((0, 1, 2), repeat=h)):
        for i, p in enumerate(pick):
            if p:
                sets[row, i if p == 1 else 2 * h - 1 - i] = 1
    return sets[np.argsort(sets @ cost, kind="stable")]


class Index:
    def __init__(self, dim: int, norm: float, width: float, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.norm, self.width = norm, width
        self.a = rng.standard_normal((TABLES, dim + 1, HASHES))
        self.b = rng.random((TABLES, HASHES))

    def place(self, v: np.ndarray, query: bool, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell of each projection, how far into the cell) of rows of vectors."""
        if query:
            u = np.pad(v / np.linalg.norm(v, axis=1, keepdims=True), ((0, 0), (0, 1)))
        else:
            u = v / self.norm
            u = np.column_stack([u, np.sqrt(np.clip(1 - (u * u).sum(1), 0, None))])
        x = u @ self.a[t] / self.width + self.b[t]
        cell = np.floor(x)
        return np.clip(cell, -127, 126).astype(np.int64), x - cell

    def probes(self, v: np.ndarray, t: int, sets: np.ndarray) -> np.ndarray:
        """Bucket keys (rows x len(sets)) that queries visit in table t, in order."""
        cell, frac = self.place(v, True, t)
        out = np.empty((len(v), len(sets)), np.int64)
        walls = np.concatenate([frac, 1 - frac], 1)
        for i in range(len(v)):
            order = np.argsort(walls[i], kind="stable")
            # the two walls of a projection sit at mirrored ranks
            move = np.zeros((2 * HASHES, HASHES), np.int64)
            half = order[:HASHES]
            move[np.arange(HASHES), half % HASHES] = np.where(half < HASHES, -1, 1)
            move[2 * HASHES - 1 - np.arange(HASHES), half % HASHES] = np.where(half < HASHES, 1, -1)
            out[i] = bucket(cell[i] + sets.astype(np.int64) @ move)
        return out


def bucket(cells: np.ndarray) -> np.ndarray:
    """Pack the cells of all projections, a byte each, into a long."""
    return np.ascontiguousarray(cells.astype(np.int8)).view(np.int64).ravel()


def _matrix(col) -> np.ndarray:
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m, np.float64)], pa.binary())


def _pack(dim: int):
    def run(batches):
        for b in batches:
            v = np.array([np.array(x, np.float64) for x in b.column("v").to_pylist()]).reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _binary(v), pa.array(np.linalg.norm(v, axis=1))], ["vec_id", "v", "norm"])
    return run


def clean_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v as packed doubles, norm) of the rows that take part, and their dimension."""
    v = F.col("embedding").cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    dims = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = dims["n"] if dims else 1
    d = d.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    return saved(d.mapInArrow(_pack(dim), "vec_id long, v binary, norm double"), "vectors"), dim


def nearest(q_id, q, v_id, v, k):
    """The k nearest rows of each query by exact inner product, the query's own
    row left out; lists of arrays (query, rows, scores)."""
    s = q @ v.T
    s[q_id[:, None] == v_id[None, :]] = -np.inf
    keep = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep] if keep else np.zeros(len(q))
    out = []
    for i in range(len(q)):
        # rows that rounding may have put on the wrong side stay; the sum below does not depend on the block
        at = np.flatnonzero((s[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) & (s[i] > -np.inf)) if np.isfinite(least[i]) else np.flatnonzero(s[i] > -np.inf)
        exact = (v[at] * q[i]).sum(1)
        top = np.lexsort((v_id[at], -exact))[:k]
        out.append((v_id[at][top], exact[top]))
    return out


class _Best:
    """The k nearest of each query so far, from blocks that may overlap."""

    def __init__(self, k):
        self.k, self.rows = k, {}

    def add(self, q_id, found):
        for q, (ids, scores) in zip(q_id.tolist(), found, strict=True):
            if q in self.rows:
                ids, scores = np.concatenate([self.rows[q][0], ids]), np.concatenate([self.rows[q][1], scores])
                ids, first = np.unique(ids, return_index=True)
                top = np.lexsort((ids, -scores[first]))[:self.k]
                ids, scores = ids[top], scores[first][top]
            self.rows[q] = ids, scores

    def table(self):
        n = [len(x[0]) for x in self.rows.values()]
        cat = lambda j, t: np.concatenate([x[j] for x in self.rows.values()]) if n else np.zeros(0, t)
        return pa.table({"query_id": np.repeat(np.array(list(self.rows), np.int64), n), "vec_id": cat(0, np.int64), "score": cat(1, np.float64)})


def _exact(q_id, q_b, k):
    def run(batches):
        best = _Best(k)
        for b in batches:
            if b.num_rows:
                best.add(q_id, nearest(q_id, q_b.value, np.array(b.column("vec_id"), np.int64), _matrix(b.column("v")), k))
        yield from best.table().to_batches()
    return run


def _hash_rows(index_b):
    def run(batches):
        for b in batches:
            v = _matrix(b.column("v"))
            if b.num_rows:
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b.num_rows, t, np.int32)), pa.array(bucket(index_b.value.place(v, False, t)[0])),
                         b.column("vec_id"), b.column("v")], ["t", "bucket", "vec_id", "v"])
    return run


def _hash_queries(index_b, sets_b):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                v = _matrix(part.column("v"))
                for t in range(TABLES):
                    keys = index_b.value.probes(v, t, sets_b.value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(keys.size, t, np.int32)), pa.array(keys.ravel()),
                         pa.array(np.repeat(np.array(part.column("vec_id"), np.int64), keys.shape[1]))], ["t", "bucket", "query_id"])
    return run


def _rank(k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(k)
        if left.num_rows and right.num_rows:
            def blocks(t, name):
                key = np.column_stack([np.array(t[c], np.int64) for c in ("t", "bucket", "s", "r")])
                u, inv = np.unique(key, axis=0, return_inverse=True)
                order = np.argsort(inv.ravel(), kind="stable")
                cut = np.searchsorted(inv.ravel()[order], np.arange(len(u) + 1))
                ids, v = np.array(t[name], np.int64), _matrix(t["v"])
                return {tuple(x): (ids[order[cut[i]:cut[i + 1]]], v[order[cut[i]:cut[i + 1]]]) for i, x in enumerate(u.tolist())}
            rows, queries = blocks(left, "vec_id"), blocks(right, "query_id")
            for key, (q_id, q) in queries.items():
                if key in rows:
                    best.add(q_id, nearest(q_id, q, *rows[key], k))
        return best.table()
    return run


def fit(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> tuple[Index, np.ndarray] | None:
    """The index and the perturbation sets to visit; None without vectors."""
    n, norm = vectors.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return None
    spark = vectors.sparkSession
    shuffled = F.xxhash64("vec_id", F.lit(1))
    sample = _matrix(pa.array([bytes(r[0]) for r in vectors.orderBy(shuffled).limit(FIT_ROWS).select("v").collect()], pa.binary()))
    # the width at which the sample, seen at the size of the whole, has buckets of the size aimed at:
    # two rows share a bucket with about the chance of rows per bucket over rows
    want, lo, hi = max(BUCKET_FACTOR / n ** 0.5, 4 / len(sample)), 0.05, 40.0
    for _ in range(12):
        mid = (lo * hi) ** 0.5
        c = np.unique(bucket(Index(dim, norm, mid).place(sample, False, 0)[0]), return_counts=True)[1]
        lo, hi = (mid, hi) if ((c / len(sample)) ** 2).sum() < want else (lo, mid)
    index, sets = Index(dim, norm, hi), probe_templates(HASHES)
    asked = queries.orderBy(shuffled).limit(FIT_QUERIES).collect()
    if not asked:
        return index, sets[:1]
    q_id, q = np.array([r["vec_id"] for r in asked]), _matrix(pa.array([bytes(r["v"]) for r in asked], pa.binary()))
    near = (vectors.mapInArrow(_exact(q_id, spark.sparkContext.broadcast(q), k), "query_id long, vec_id long, score double")
            .withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("i") <= k))
    true = near.join(vectors, "vec_id").select("query_id", "v").collect()  # FIT_QUERIES * k rows at most
    if not true:
        return index, sets[:1]
    of = {x: i for i, x in enumerate(q_id.tolist())}
    v, row = _matrix(pa.array([bytes(r["v"]) for r in true], pa.binary())), np.array([of[r["query_id"]] for r in true])
    at_least = int(np.ceil(TARGET * len(v))) - 1
    while True:
        need = np.full(len(v), len(sets))
        for t in range(TABLES):
            keys, at = index.probes(q, t, sets), bucket(index.place(v, False, t)[0])
            hit = keys[row] == at[:, None]
            need = np.minimum(need, np.where(hit.any(1), hit.argmax(1), len(sets)))
        need.sort()
        if need[at_least] < len(sets):
            return index, sets[:int(need[at_least]) + 1]
        # too many neighbours lie beyond the next buckets: wider ones
        index = Index(dim, norm, index.width * 1.3)


def search(df: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest rows found
    for every row whose vec_id is divisible by ``every``: largest inner product
    first, ties to the smaller vec_id.

    Defined cases: vectors that are null, all zero or hold a null or non-finite
    component take no part, nor do rows without an id or of another length
    than most; an id with several vectors counts once, with the least of them;
    a query whose probes meet fewer than k rows is compared with all rows, so
    fewer candidates than k are all returned; an empty table gives no rows;
    other columns are not looked at.
    """
    spark = df.sparkSession
    importable(spark)
    vectors, dim = clean_vectors(df)
    queries = vectors.where(F.col("vec_id") % every == 0)
    got = fit(vectors, queries, dim, k)
    if got is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, sets = (spark.sparkContext.broadcast(x) for x in got)
    rows = saved(vectors.select("vec_id", "v").mapInArrow(_hash_rows(index), "t int, bucket long, vec_id long, v binary"), "index")
    probes = saved(queries.select("vec_id", "v").mapInArrow(_hash_queries(index, sets), "t int, bucket long, query_id long"), "probes")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    sizes = (rows.groupBy("t", "bucket").agg(F.count("*").alias("n"))
             .join(probes.groupBy("t", "bucket").agg(F.count("*").alias("m")), ["t", "bucket"])
             .select("t", "bucket", blocks("n").alias("row_blocks"), blocks("m").alias("query_blocks")))
    sizes = small_or_plain(saved(sizes, "buckets"), 32)
    cells = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 50_000)
    cell = F.pmod(F.xxhash64("t", "bucket", "s", "r"), F.lit(cells)).alias("cell")
    left = (rows.join(sizes, ["t", "bucket"])
            .select("t", "bucket", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int").alias("s"),
                    F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("r")).withColumn("cell", cell))
    right = (probes.join(sizes, ["t", "bucket"])
             .select("t", "bucket", "query_id", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("r"),
                     F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("s"))
             .join(queries.select(F.col("vec_id").alias("query_id"), "v"), "query_id").withColumn("cell", cell))
    near = (left.groupBy("cell").cogroup(right.groupBy("cell"))
            .applyInArrow(_rank(k), "query_id long, vec_id long, score double"))
    # a row met in several tables comes from several cells: it counts once
    near = saved(near.distinct(), "near")
    # queries whose buckets held fewer than k rows: all rows, a bounded block of queries at a time
    least = min(k, vectors.count() - 1)
    full = near.groupBy("query_id").count().where(F.col("count") >= least).select(F.col("query_id").alias("vec_id"))
    short = saved(queries.select("vec_id", "v").join(full, "vec_id", "left_anti").withColumn("i", F.monotonically_increasing_id())
                  .withColumn("part", F.pmod(F.xxhash64("i"), F.lit(1 + queries.count() // BLOCK_ROWS))), "short")
    for part in [r[0] for r in short.select("part").distinct().collect()]:
        asked = short.where(F.col("part") == part).collect()
        q_id, q = np.array([r["vec_id"] for r in asked]), _matrix(pa.array([bytes(r["v"]) for r in asked], pa.binary()))
        more = vectors.mapInArrow(_exact(q_id, spark.sparkContext.broadcast(q), k), "query_id long, vec_id long, score double")
        near = near.unionByName(saved(more, "exact"))
    near = near.distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
