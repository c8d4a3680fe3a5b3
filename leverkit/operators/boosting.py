"""Boosted trees in one job: MLlib's recipe without a chain of jobs a round.

MLlib grows a tree level by level and runs a Spark job, or more, for each, so
thousands of rounds are tens of thousands of jobs that wait for each other.
Here the rows are binned once, each task of one barrier stage keeps its share
of them as bytes, and the tasks add up their histograms level by level through
small files in the cluster-shared folder (``shared_dir``).  All tasks see the
same sums and so make the same splits; no row moves after the first deal.

The recipe is that of ``GBTRegressor`` and ``GBTClassifier``: at most
``BINS`` bins a feature with MLlib's thresholds, variance gain, the first tree on
the labels, each later one on the negative gradient, ``minInstancesPerNode``, and
a sample of rows a tree.  Without that sample the trees are MLlib's own
(``tests/test_boosting.py``).  Thresholds come from all rows, where MLlib takes
them from a sample of about 10,000.

Several fits go on side by side and share each exchange: the refit on all rows
grows along with the tuning fit and is cut at the rounds that this one finds.
"""
from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, shared_dir

BINS = 64
#: values a summary of a feature's distribution has at most; no loss below
SUMMARY = 2048
#: rows a task has at least: an exchange takes longer the more tasks there are
ROWS_A_TASK = 50_000
#: rows of which a histogram is made at a time, and the codes that a group of features has at most
CHUNK, CODES = 65_536, 4096
#: seconds without news of another task after which a task gives up
SILENCE = 900


@dataclass
class Job:
    """One fit: on the training rows or on all, with the bins of one vector column."""
    vector: int
    params: dict
    kind: str
    least: int
    max_rounds: int
    seed: int = 101
    all_rows: bool = False
    #: held-out rounds without a better one after which it ends; None: no held-out loss
    patience: int | None = None
    #: the job whose end is this one's end
    follows: int | None = None


# ------------------------------------------------------------- on the driver
def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: all run at once.  0: it takes several, but the
    cluster does not hold its slots or tasks cannot reach the shared folder as files."""
    sc = spark.sparkContext
    if rows < 2 * ROWS_A_TASK:
        return 1
    jsc = sc._jsc.sc()
    slots = jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())
    n = max(1, min(slots, rows // ROWS_A_TASK))
    changing = sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    return n if n == 1 or not changing and _as_file(spark, shared_dir(spark)) else 0


def _as_file(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it, if it is one of a mounted folder."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(conf).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _summary(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their counts; of more than SUMMARY, those
    at equal distances in rank, each with the rows up to it."""
    v, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights=counts, minlength=len(v))
    if len(v) > SUMMARY:
        up = np.cumsum(n)
        keep = np.unique(np.searchsorted(up, up[-1] * np.arange(1, SUMMARY + 1) / SUMMARY, side="left").clip(max=len(v) - 1))
        v, n = v[keep], np.diff(up[keep], prepend=0.0)
    return v, n


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """MLlib's thresholds of a continuous feature: between all neighbours, or
    where the count comes closest to the next multiple of the stride."""
    mids = (values[:-1] + values[1:]) / 2
    total = counts.sum()
    splits = int(min(bins, total)) - 1
    if len(mids) <= splits:
        return mids
    up = np.cumsum(counts)
    both, out, i = up[:-1] + up[1:], [], -1
    stride = total / (splits + 1)
    target = stride
    while True:
        i = max(i + 1, int(np.searchsorted(both, 2 * target, side="right")))
        if i >= len(mids):
            return np.array(out)
        out.append(mids[i])
        target += stride


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column with lists of one length, as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _find_thresholds(x: DataFrame, on_all: Sequence[bool]) -> list[list[np.ndarray]]:
    """Thresholds of each feature of each vector: summaries where the rows are,
    put together by feature.  A vector counts its training rows, or all."""
    on_all = list(on_all)

    def summaries(batches):
        seen = {}
        for b in batches:
            if not b.num_rows:
                continue
            train = b.column("t").to_numpy(zero_copy_only=False) == 1
            for s, every in enumerate(on_all):
                m = _arrays(b, f"v{s}")
                m = m if every else m[train]
                for c in range(m.shape[1]):
                    v, n = _summary(m[:, c], np.ones(len(m)))
                    if (s, c) in seen:
                        v, n = np.concatenate([seen[s, c][0], v]), np.concatenate([seen[s, c][1], n])
                        v, n = _summary(v, n)
                    seen[s, c] = v, n
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({
            "s": pa.array([k[0] for k in keys], pa.int32()), "c": pa.array([k[1] for k in keys], pa.int32()),
            "v": pa.array([seen[k][0] for k in keys], pa.list_(pa.float64())),
            "n": pa.array([seen[k][1] for k in keys], pa.list_(pa.float64()))})

    def together(key, group):
        v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = group.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        u, at = np.unique(v, return_inverse=True)
        got = thresholds(u, np.bincount(at, weights=n, minlength=len(u)))
        return pa.table({"s": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([key[1].as_py()], pa.int32()),
                         "at": pa.array([got], pa.list_(pa.float64()))})

    parts = x.mapInArrow(summaries, "s int, c int, v array<double>, n array<double>")
    found = parts.groupBy("s", "c").applyInArrow(together, "s int, c int, at array<double>").collect()
    out = [[] for _ in on_all]
    for r in sorted(found, key=lambda r: (r.s, r.c)):
        out[r.s].append(np.array(r["at"], dtype=float))
    return out


def boost(rows: DataFrame, label: str, vectors: Sequence[str], jobs: Sequence[Job], tasks: int
          ) -> tuple[list[dict], list[list[np.ndarray]]]:
    """Fit the jobs side by side.  ``rows`` has ``label``, ``is_train`` and the
    vector columns.  For each job its ``losses`` and ``trees``, and the thresholds
    of each vector's features."""
    spark = rows.sparkSession
    importable(spark)
    jobs = list(jobs)
    x = rows.select(F.col(label).cast("double").alias("y"), F.col("is_train").cast("int").alias("t"),
                    *[vector_to_array(F.col(v)).alias(f"v{i}") for i, v in enumerate(vectors)])
    cuts = _find_thresholds(x, [all(j.all_rows for j in jobs if j.vector == i) for i in range(len(vectors))])
    if not any(cuts):
        raise ValueError("there are no rows to fit")

    def binned(batches):
        for b in batches:
            parts = [np.zeros((b.num_rows, 0), np.uint8)]
            for s, at in enumerate(cuts):
                m = _arrays(b, f"v{s}") if b.num_rows else np.zeros((0, len(at)))
                parts += [np.searchsorted(a, m[:, c], side="left").astype(np.uint8)[:, None] for c, a in enumerate(at)]
            m = np.ascontiguousarray(np.hstack(parts))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * m.shape[1]
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), b.column("t"), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(m)])],
                names=["y", "t", "x"])

    n_bins = [[len(a) + 1 for a in at] for at in cuts]
    folder = f"{shared_dir(spark)}/boosting-{uuid.uuid4().hex}"
    path = _as_file(spark, folder) if tasks > 1 else None

    def fit(batches):
        ys, ts, xs = [], [], []
        for b in batches:
            ys.append(b.column("y").to_numpy(zero_copy_only=False))
            ts.append(b.column("t").to_numpy(zero_copy_only=False))
            xs.append(np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(b.num_rows, -1))
        width = sum(map(len, n_bins))
        y = np.concatenate([np.zeros(0), *ys])
        t = np.concatenate([np.zeros(0, np.int32), *ts]) == 1
        x = np.concatenate([np.zeros((0, width), np.uint8), *xs])
        del ys, ts, xs
        me, both = 0, _Alone()
        if path:
            from pyspark import BarrierTaskContext
            ctx = BarrierTaskContext.get()
            me = ctx.partitionId()
            # a stage that is tried again has other task ids, and so a folder of its own
            both = _Folder(f"{path}/{ctx.allGather(str(ctx.taskAttemptId()))[0]}", me, tasks)
        done = _together(x, y, t, n_bins, jobs, both, me)
        if me == 0:
            yield from _as_batches(done)

    dealt = x.mapInArrow(binned, "y double, t int, x binary").repartition(tasks)
    try:
        got = dealt.mapInArrow(fit, _OUT, barrier=tasks > 1).toArrow().to_pydict()
    finally:
        if path:
            _remove(spark, folder)
    out = [{"losses": [], "trees": []} for _ in jobs]
    for i in sorted(range(len(got["job"])), key=lambda i: (got["job"][i], got["tree"][i])):
        o = out[got["job"][i]]
        o["trees"].append({k: got[k][i] for k in ("node", "feature", "bin", "stats", "gain")})
        if got["loss"][i] is not None:
            o["losses"].append(got["loss"][i])
    return out, cuts


# ------------------------------------------------------------- in the tasks
_OUT = "job int, tree int, loss double, node array<int>, feature array<int>, bin array<int>, stats array<double>, gain array<double>"


def _as_batches(fits):
    for i, f in enumerate(fits):
        for a in range(0, len(f.trees), 500):
            trees = f.trees[a:a + 500]
            loss = [f.losses[a + k] if a + k < len(f.losses) else None for k in range(len(trees))]
            yield pa.RecordBatch.from_arrays([
                pa.array([i] * len(trees), pa.int32()), pa.array(range(a, a + len(trees)), pa.int32()), pa.array(loss, pa.float64()),
                *[pa.array([t[k] for t in trees], pa.list_(kind)) for k, kind in
                  (("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("stats", pa.float64()), ("gain", pa.float64()))]],
                names=["job", "tree", "loss", "node", "feature", "bin", "stats", "gain"])


class _Alone:
    def total(self, part: np.ndarray) -> np.ndarray:
        return part


class _Folder:
    """Sums over the tasks of a stage, through files that all of them see.

    A task writes its k-th part under another name and renames it, so a part is
    seen whole or not at all.  Whoever has all k-th parts knows that all have
    read the parts before them: two names a task are enough.
    """

    def __init__(self, path: str, me: int, n: int):
        os.makedirs(path, exist_ok=True)
        self.path, self.me, self.n, self.k = path, me, n, 0

    def total(self, part: np.ndarray) -> np.ndarray:
        self.k += 1
        mine = f"{self.path}/{self.me}.{self.k % 2}"
        with open(mine + ".new", "wb") as f:
            f.write(np.int64(self.k).tobytes())
            f.write(np.ascontiguousarray(part, dtype=np.float64).data)
        os.replace(mine + ".new", mine)
        out = np.zeros(len(part))
        for i in range(self.n):  # in the same order everywhere: the sums are the same to the last bit
            out += part if i == self.me else self._read(i)
        return out

    def _read(self, i: int) -> np.ndarray:
        name, wait, end = f"{self.path}/{i}.{self.k % 2}", 1e-4, time.monotonic() + SILENCE
        while True:
            try:
                with open(name, "rb") as f:
                    if int.from_bytes(f.read(8), "little") == self.k:
                        return np.frombuffer(f.read(), np.float64)
            except FileNotFoundError:
                pass
            if time.monotonic() > end:
                raise TimeoutError(f"no news of task {i} of the boosting for {SILENCE} s")
            time.sleep(wait)
            wait = min(wait * 1.2, 0.01)


def _packed(x: np.ndarray, n_bins: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of features, each with one code a row for the bins of all of them:
    a group is as large as the combinations that these rows have allow.  For each
    group its codes, and the matrix from codes to the bins of all features."""
    limit = min(CODES, max(BINS, len(x) // 128))
    start = np.cumsum([0, *n_bins])
    groups = []  # [codes, rows of combinations, features]
    for f, n in enumerate(n_bins):
        for g in groups:
            if len(g[1]) * n > limit * BINS:
                continue
            code = g[0].astype(np.int64) * n + x[:, f]
            there = np.bincount(code, minlength=len(g[1]) * n) > 0
            if there.sum() > limit:
                continue
            was = np.flatnonzero(there)
            g[0] = (np.cumsum(there) - 1)[code].astype(np.uint16)
            g[1] = np.hstack([g[1][was // n], (was % n)[:, None]])
            g[2].append(f)
            break
        else:
            groups.append([x[:, f].astype(np.uint16), np.arange(n)[:, None], [f]])
    out = []
    for code, combos, features in groups:
        to = np.zeros((len(combos), start[-1]))
        for k, f in enumerate(features):
            to[np.arange(len(combos)), start[f] + combos[:, k]] = 1
        cols = np.flatnonzero(to.any(axis=0))
        out.append((code, np.ascontiguousarray(to[:, cols]), cols))
    return out


class _Fit:
    """One fit's state in one task.  Trees are heaps: node i has children 2i and 2i + 1."""

    def __init__(self, job: Job, me: int, x: np.ndarray, y: np.ndarray, n_train: int, n_bins: Sequence[int]):
        p = job.params
        self.job, self.me, self.n_train = job, me, n_train
        self.depth, self.rate, self.eta = int(p.get("max_depth", 4)), float(p.get("subsample", 1.0)), float(p.get("eta", 0.3))
        self.logistic = job.kind == "classifier"
        self.y = 2 * y - 1 if self.logistic else y
        self.m = len(y) if job.all_rows else n_train
        self.features = np.array([f for f, n in enumerate(n_bins) if n > 1], dtype=np.int64)
        self.x = np.ascontiguousarray(x[:, self.features])
        bins = [n_bins[f] for f in self.features]
        self.width = sum(bins)
        self.pos = np.concatenate([np.zeros(0, np.int64), *[f * BINS + np.arange(n) for f, n in enumerate(bins)]])
        self.may = np.arange(BINS)[None, :] < np.array(bins, dtype=np.int64).reshape(-1, 1) - 1
        self.groups = _packed(self.x[:self.m], bins)
        self.pred = np.zeros(len(y))
        self.trees, self.losses, self.tail, self.best, self.done, self.root_counts = [], [], None, 0, False, None

    # a tree
    def start(self, t: int) -> None:
        y = self.y[:self.m]
        if t == 0:
            self.r = y.copy()
        elif self.logistic:
            self.r = 4 * y / (1 + np.exp(np.minimum(2 * y * self.pred[:self.m], 700)))
        else:
            self.r = 2 * (y - self.pred[:self.m])
        self.rows = None
        if self.rate < 1:
            draw = np.random.default_rng([self.job.seed, t, self.me]).random(self.m, dtype=np.float32)
            self.rows = np.flatnonzero(draw < self.rate)
            self.r = self.r[self.rows]
        size = 2 << self.depth
        self.node = np.ones(len(self.y), np.int16)
        self.split, self.feature, self.bin = np.zeros(size, bool), np.zeros(size, np.int64), np.full(size, 255, np.int64)
        self.count, self.sum, self.gain = np.zeros(size), np.zeros(size), np.full(size, -1.0)
        self.level, self.hists, self.build, self.scale = 0, {}, [1], 1.0 if t == 0 else self.eta

    def _histogram(self, k: int, rows, slot, r, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
        sums, ns = np.zeros((k, self.width)), np.zeros((k, self.width))
        for code, to, cols in self.groups:
            size = k * len(to)
            s, c = np.zeros(size), np.zeros(size)
            for a in range(0, len(r), CHUNK):
                at = code[a:a + CHUNK] if rows is None else code[rows[a:a + CHUNK]]
                at = at.astype(np.int64)
                if k > 1:
                    at += slot[a:a + CHUNK] * len(to)
                s += np.bincount(at, weights=r[a:a + CHUNK], minlength=size)
                if counts:
                    c += np.bincount(at, minlength=size)
            sums[:, cols] += s.reshape(k, -1) @ to
            if counts:
                ns[:, cols] += c.reshape(k, -1) @ to
        return sums, ns

    def part(self) -> np.ndarray:
        """This task's sums for the level: of the root, or of the smaller child of each split."""
        if not self.build or self.level >= self.depth:
            return np.zeros(0)
        if self.level == 0:
            keep = self.rows is None
            if keep and self.root_counts is not None:
                sums, ns = self._histogram(1, None, None, self.r, counts=False)[0], self.root_counts
            else:
                sums, ns = self._histogram(1, self.rows, None, self.r)
                self.root_counts = ns if keep else None
            return np.concatenate([[len(self.r), self.r.sum()], sums.ravel(), ns.ravel()])
        place = np.full(2 << self.depth, -1, np.int16)
        place[self.build] = np.arange(len(self.build))
        slot = place[self.node[:self.m] if self.rows is None else self.node[self.rows]]
        sel = np.flatnonzero(slot >= 0)
        sums, ns = self._histogram(len(self.build), sel if self.rows is None else self.rows[sel], slot[sel].astype(np.int64), self.r[sel])
        return np.concatenate([sums.ravel(), ns.ravel()])

    def take(self, total: np.ndarray) -> None:
        """Split the level's nodes by the sums of all tasks and send the rows down."""
        if self.level >= self.depth:
            return
        if self.level == 0:
            self.count[1], self.sum[1] = total[:2]
            total = total[2:]
        k, least = len(self.build), self.job.least
        sums, ns = total.reshape(2, k, self.width) if k else np.zeros((2, 0, self.width))
        hists = {}
        for i, node in enumerate(self.build):
            hists[node] = sums[i], ns[i]
            if node > 1:
                up = self.hists[node // 2]
                hists[node ^ 1] = up[0] - sums[i], up[1] - ns[i]
        self.hists = {n: h for n, h in hists.items() if self.count[n] >= 2 * least and self.width}
        self._choose(list(self.hists), least)
        self.level += 1
        self.build = []
        for node in self.hists:
            if self.split[node]:
                small, large = sorted((2 * node, 2 * node + 1), key=lambda n: (self.count[n], n))
                if self.level < self.depth and self.count[large] >= 2 * least:
                    self.build.append(small)
        if any(self.split[n] for n in self.hists):
            self._descend()

    def _choose(self, nodes: list[int], least: int) -> None:
        if not nodes:
            return
        f = len(self.features)
        both = np.zeros((2, len(nodes), f * BINS))
        for i, n in enumerate(nodes):
            both[0, i, self.pos], both[1, i, self.pos] = self.hists[n]
        sl, cl = np.cumsum(both.reshape(2, len(nodes), f, BINS), axis=3)
        s, c = self.sum[nodes].reshape(-1, 1, 1), self.count[nodes].reshape(-1, 1, 1)
        sr, cr = s - sl, c - cl
        ok = self.may & (cl >= least) & (cr >= least)
        whole = s * s / c
        gain = np.where(ok, sl * sl / np.maximum(cl, 1) + sr * sr / np.maximum(cr, 1) - whole, -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)  # the first of equal ones
        for i, n in enumerate(nodes):
            # less than what the sums are rounded by is no gain
            if not gain[i, best[i]] > 1e-13 * whole[i, 0, 0]:
                continue
            at = divmod(int(best[i]), BINS)
            self.split[n], self.feature[n], self.bin[n], self.gain[n] = True, at[0], at[1], gain[i, best[i]] / self.count[n]
            for child, cs, ss in ((2 * n, cl, sl), (2 * n + 1, cr, sr)):
                self.count[child], self.sum[child] = cs[i][at], ss[i][at]

    def _descend(self) -> None:
        f = self.x.shape[1]
        size = len(self.split)
        to = np.repeat(np.arange(size, dtype=np.int16), 2)  # by 2 * node + right
        for n in np.flatnonzero(self.split):
            to[2 * n], to[2 * n + 1] = 2 * n, 2 * n + 1
        feature, cut = self.feature.astype(np.int32), self.bin.astype(np.uint8)
        base = np.arange(min(CHUNK, len(self.node)), dtype=np.int32) * f
        for a in range(0, len(self.node), CHUNK):
            node = self.node[a:a + CHUNK]
            at = feature.take(node)
            at += base[:len(node)]
            right = self.x[a:a + CHUNK].reshape(-1).take(at) > cut.take(node)
            self.node[a:a + CHUNK] = to.take(2 * node + right)

    def finish(self) -> None:
        """The tree's values go to the rows; its squares and the held-out loss wait for the next exchange."""
        value = self.scale * np.divide(self.sum, self.count, out=np.zeros(len(self.sum)), where=self.count > 0)
        self.pred += value.take(self.node)
        node = self.node[:self.m] if self.rows is None else self.node[self.rows]
        squares = np.bincount(node, weights=self.r * self.r, minlength=len(self.sum))
        self.trees.append((self.split, self.feature, self.bin, self.count, self.sum, self.gain))
        loss = []
        if self.job.patience is not None:
            y, p = self.y[self.n_train:], self.pred[self.n_train:]
            loss = [len(y), (2 * np.logaddexp(0, -2 * y * p)).sum() if self.logistic else ((y - p) ** 2).sum()]
        self.tail = np.concatenate([squares, loss])

    def settle(self, tail: np.ndarray) -> None:
        """The last tree with the sums of all tasks; whether it was the last."""
        split, feature, at, count, total, gain = self.trees[-1]
        size = len(split)
        squares = tail[:size].copy()
        for n in range(size // 2 - 1, 0, -1):
            if split[n]:
                squares[n] = squares[2 * n] + squares[2 * n + 1]
        there = np.flatnonzero((count > 0) | (np.arange(size) == 1))
        self.trees[-1] = {"node": there.astype(np.int32), "feature": np.where(split, self.features[feature] if len(self.features) else -1, -1)[there].astype(np.int32),
                          "bin": np.where(split, at, -1)[there].astype(np.int32),
                          "stats": np.stack([count, total, squares], axis=1)[there].ravel(), "gain": gain[there]}
        if self.job.patience is not None:
            loss = tail[size + 1] / tail[size] if tail[size] else float("nan")
            self.losses.append(loss)
            i = len(self.losses) - 1
            self.best = i if loss < self.losses[self.best] else self.best
            self.done = self.best + self.job.patience <= i
        self.tail = None


def _together(x, y, train, n_bins, jobs: Sequence[Job], both, me: int) -> list[_Fit]:
    """Grow the jobs' trees round by round, all on one exchange a level."""
    # the same order whatever order the rows came in, the training rows first
    key = x.view(f"S{x.shape[1]}").ravel() if x.shape[1] else np.zeros(len(y))
    order = np.lexsort((y, key, ~train))
    x, y, n_train = x[order], y[order], int(train.sum())
    start = np.cumsum([0, *map(len, n_bins)])
    fits = [_Fit(j, me, x[:, start[j.vector]:start[j.vector + 1]], y, n_train, n_bins[j.vector]) for j in jobs]
    del x, y, key, order

    def exchange(parts):
        if not any(map(len, parts)):
            return parts
        return np.split(both.total(np.concatenate(parts)), np.cumsum([len(p) for p in parts])[:-1])

    t, over, live = 0, False, []
    while not over:
        live = [f for f in fits if not f.done and t < f.job.max_rounds]
        waiting = [f for f in fits if f.tail is not None]
        over = not live
        for f in live:
            f.start(t)
        for level in range(max((f.depth for f in live), default=1)):
            tails = [f.tail for f in waiting] if level == 0 else []
            got = exchange([*tails, *[f.part() for f in live]])
            for f, g in zip(waiting, got) if level == 0 else ():
                f.settle(g)
            for f in fits if level == 0 else ():
                f.done = f.done or f.job.follows is not None and fits[f.job.follows].done
            at = len(tails)
            going = []
            for f, g in zip(live, got[at:]):
                if not f.done:  # a tree begun beyond the last one is dropped
                    f.take(g)
                    going.append(f)
            live = going
            if not live:
                break
        for f in live:
            f.finish()
        t += 1
    return fits


# ------------------------------------------------------------- scoring
@dataclass
class Forest:
    """A model's trees as arrays: by tree and node, with a node's children (a
    leaf is its own) and the place of its threshold among its feature's."""
    cuts: dict[int, np.ndarray]
    feature: list[np.ndarray]
    bin: list[np.ndarray]
    child: list[np.ndarray]
    value: list[np.ndarray]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The weighted sum of the trees for each row."""
        used = sorted(self.cuts)
        m = np.ascontiguousarray(np.stack([np.searchsorted(self.cuts[f], x[:, f], side="left") for f in used], axis=1).astype(np.int32)) \
            if used else np.zeros((len(x), 1), np.int32)
        out, flat = np.zeros(len(x)), m.reshape(-1)
        base = np.arange(len(x), dtype=np.int32) * m.shape[1]
        for feature, at, child, value in zip(self.feature, self.bin, self.child, self.value):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth if len(value) > 1 else 0):
                i = feature.take(node)
                i += base
                node = child.take(2 * node + (flat.take(i) > at.take(node)))
            out += value.take(node)
        return out


def forest(model) -> Forest:
    """The trees of MLlib's model, read as MLlib writes them."""
    spark = SparkSession.getActiveSession()
    folder = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    try:
        model.write().save(folder)
        rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").toArrow().to_pandas()
    finally:
        _remove(spark, folder)
    split = rows["split"].tolist()
    rows["f"] = [s["featureIndex"] for s in split]
    rows["at"] = [s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 else 0.0 for s in split]
    rows = rows.sort_values(["treeID", "id"])
    cuts = {int(f): np.unique(g) for f, g in rows[rows["f"] >= 0].groupby("f")["at"]}
    place = {f: i for i, f in enumerate(sorted(cuts))}
    out = Forest(cuts, [], [], [], [], 0)
    for (_, t), weight in zip(rows.groupby("treeID"), model.treeWeights):
        f, left, right, me = (t[c].to_numpy() for c in ("f", "leftChild", "rightChild", "id"))
        inner = f >= 0
        out.feature.append(np.array([place.get(int(k), 0) for k in f], dtype=np.int32))
        out.bin.append(np.array([np.searchsorted(cuts[int(k)], a) if k >= 0 else 0 for k, a in zip(f, t["at"])], dtype=np.int32))
        out.child.append(np.stack([np.where(inner, left, me), np.where(inner, right, me)], axis=1).ravel().astype(np.int32))
        out.value.append(weight * t["prediction"].to_numpy())
        level = np.zeros(len(f), np.int64)
        for i in np.flatnonzero(inner):  # a node comes before its children
            level[[left[i], right[i]]] = level[i] + 1
        out.depth = max(out.depth, int(level.max()))
    return out


def predicted(trees: Forest, vector, logistic: bool):
    """Column of the predictions (P(label = 1) if ``logistic``) for a vector column."""
    @F.arrow_udf("double")
    def predict(x: pa.Array) -> pa.Array:
        m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
        out = trees.margin(m) if len(x) else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-2 * out)) if logistic else out, pa.float64())
    return predict(vector_to_array(vector))


# ------------------------------------------------------------- MLlib's model
_NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                   ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                   ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
                                        ("numCategories", pa.int32())]))])


def _nodes(tree: dict, cuts: Sequence[np.ndarray]) -> list[dict]:
    """The nodes of a tree in MLlib's order: each before its children, the left ones first."""
    at = {n: i for i, n in enumerate(tree["node"])}
    out, todo = [], [(1, None)]
    while todo:
        n, of = todo.pop()
        i = at[n]
        if of is not None:
            of[0][of[1]] = len(out)
        count, total, squares = tree["stats"][3 * i:3 * i + 3]
        f = tree["feature"][i]
        row = {"id": len(out), "prediction": total / count if count else 0.0,
               "impurity": max(squares - total * total / count, 0.0) / count if count else 0.0,
               "impurityStats": [count, total, squares], "rawCount": int(count), "gain": tree["gain"][i], "leftChild": -1, "rightChild": -1,
               "split": {"featureIndex": f, "leftCategoriesOrThreshold": [float(cuts[f][tree["bin"][i]])] if f >= 0 else [], "numCategories": -1}}
        out.append(row)
        if f >= 0:
            todo += [(2 * n + 1, (row, "rightChild")), (2 * n, (row, "leftChild"))]
    return out


def as_model(spark: SparkSession, est, trees: Sequence[dict], cuts: Sequence[np.ndarray]):
    """MLlib's model of these trees with the parameters of ``est``: written as
    MLlib writes one and loaded."""
    classify = type(est).__name__ == "GBTClassifier"
    cls, name = (GBTClassificationModel, "classification.GBTClassificationModel") if classify else (GBTRegressionModel, "regression.GBTRegressionModel")
    now = int(time.time() * 1000)

    def meta(name, uid, own, given, **more):
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": now, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": own, "defaultParamMap": given, **more})

    own = {p.name: v for p, v in est._paramMap.items()}
    given = {p.name: v for p, v in est._defaultParamMap.items()}
    # a model of no choice of its own has MLlib's defaults of a tree
    tree_given = {k: given[k] for k in ("cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
                                        "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol")}
    tree_own = {k: v for k, v in own.items() if k in ("labelCol", "featuresCol", "maxDepth", "maxBins", "minInstancesPerNode", "checkpointInterval")}
    trees = list(trees)
    folder = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    rows = [(i, n) for i, t in enumerate(trees) for n in _nodes(t, cuts)]
    data = pa.table({"treeID": pa.array([r[0] for r in rows], pa.int32()), "nodeData": pa.array([r[1] for r in rows], _NODE)})
    metas = pa.table({"_1": pa.array(range(len(trees)), pa.int32()),
                      "_2": [meta("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", tree_own, tree_given) for _ in trees],
                      "_3": pa.array([own["stepSize"] if i else 1.0 for i in range(len(trees))], pa.float64())})
    try:
        spark.createDataFrame([(meta(name, f"{type(est).__name__}_{uuid.uuid4().hex[:12]}", own, given,
                                     numFeatures=len(cuts), numTrees=len(trees)),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
        spark.createDataFrame(data).write.parquet(f"{folder}/data")
        spark.createDataFrame(metas).write.parquet(f"{folder}/treesMetadata")
        return cls.load(folder)
    finally:
        _remove(spark, folder)
