"""Operator 12: hard-negative mining by Fagin's threshold algorithm.

Candidates are dealt into blocks.  A block has one candidate list per
dimension, sorted by that component.  For an anchor, every list is read from
its high end where the anchor's component is positive and from its low end
where it is negative (a zero needs no list): sorted access.  A row seen for the
first time gets its whole integer score: random access.  The threshold is the
score of a row that had, in every list, the component read last; no unseen row
scores more.  Each window of an anchor keeps its ``k`` best rows and is settled
once the threshold is strictly below its kth score (a row with the same score
and a smaller id could still be unseen otherwise) or below its lower bound; an
anchor stops when all its windows are settled.  The settled bests of all blocks
are merged by a ranked window.

Two passes: the positives of an anchor are one window without bounds over the
rows of its label; each positive then opens a window over the other rows.

Both blocks of rows and blocks of anchors are bounded and dealt by a hash, so
neither a common label nor many anchors land in one task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leverkit.llm.common import importable, saved, table

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH, DEN = 30, 90, 100
SCALE = 256
#: rows and anchors of a block at most (on average); rows at least, if there are that many
ROWS, LEAST_ROWS, ANCHORS = 16384, 1024, 4096
#: entries read from each list before the threshold is looked at first; doubled each time
STEP = 8
#: integers up to this are exact in double precision
EXACT = 1 << 53


class Lists:
    """Rows of a block with one sorted list per dimension."""

    def __init__(self, v: np.ndarray):
        n, dim = v.shape
        self.n, self.dim = n, dim
        most = int(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))))
        self.most, self.whole = most, v
        self.fast = v.astype(np.float64)
        self.order = np.argsort(v, axis=0, kind="stable").T  # (dim, n) ascending

    def access(self, anchor: np.ndarray, settled) -> tuple[np.ndarray, list[int]]:
        """(rows, scores) seen until ``settled(rows, scores, threshold)``."""
        near = int(np.abs(anchor.astype(object)).max()) if self.dim else 0
        exact = max(1, self.dim) * self.most * near < EXACT
        v, a = (self.fast, anchor.astype(np.float64)) if exact else (self.whole.astype(object), anchor.astype(object))
        dims = np.flatnonzero(anchor)
        up = anchor[dims] > 0
        seen = np.zeros(self.n, bool)
        rows, scores, depth, step = np.zeros(0, np.int64), [], 0, STEP
        while True:
            if not len(dims):  # every row scores zero
                new, threshold, depth = np.arange(self.n), None, self.n
            else:
                to = min(self.n, depth + step)
                at = np.concatenate([self.order[dims[up], self.n - to:self.n - depth].ravel(), self.order[dims[~up], depth:to].ravel()])
                fresh = np.zeros(self.n, bool)
                fresh[at] = True
                new = np.flatnonzero(fresh & ~seen)
                last = np.where(up, self.order[dims, self.n - to], self.order[dims, to - 1])
                threshold = (v[last, dims] * a[dims]).sum()
                depth, step = to, 2 * step
            seen[new] = True
            rows = np.concatenate([rows, new])
            scores.append(v[new] @ a if len(new) * 4 < self.n else (v @ a)[new])
            if len(rows) == self.n or depth >= self.n:
                threshold = None
            if settled(new, scores[-1], threshold):
                return rows, depth


class Best:
    """The ``k`` best rows of each window of one anchor."""

    def __init__(self, windows, k, ids, fits):
        # windows: (low, high) bounds as 100-fold scores, None for none
        self.windows, self.k, self.ids, self.fits = windows, k, ids, fits
        self.rows = [np.zeros(0, np.int64) for _ in windows]
        self.scores = [np.zeros(0) for _ in windows]

    def settled(self, rows, scores, threshold) -> bool:
        keep = self.fits[rows]
        rows, scores = rows[keep], scores[keep]
        done = True
        for i, (low, high) in enumerate(self.windows):
            if low is not None and low > high:
                continue
            r, s = rows, scores
            if len(r):
                if low is not None:
                    inside = (DEN * s >= low) & (DEN * s <= high)
                    r, s = r[inside], s[inside]
                r, s = np.concatenate([self.rows[i], r]), np.concatenate([self.scores[i], s])
                top = np.lexsort((self.ids[r], -s))[:self.k]
                self.rows[i], self.scores[i] = r[top], s[top]
            if threshold is None or low is not None and DEN * threshold < low:
                continue
            if len(self.rows[i]) < self.k or threshold >= self.scores[i][-1]:
                done = False
        return done or threshold is None


def _clip(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def _matrix(t: pa.Table) -> np.ndarray:
    if not t.num_rows:
        return np.zeros((0, 0), np.int64)
    v = t["v"].combine_chunks()
    return np.array(v.flatten(), np.int64).reshape(t.num_rows, -1)


_OUT = "aid long, pid long, rid long, vec_id long, score long"


def _mine(k: int, same: bool):
    """Rows meet anchors; ``rid`` tells rows apart, ``pid`` an anchor's windows."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rid, label = np.array(left["rid"], np.int64), np.array(left["label"], np.int64)
            ids = left["vec_id"].to_pylist()
            # by vec_id, null last; equal ones by rid, as for repeated rows
            place = np.empty(len(ids), np.int64)
            place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rid[i]))] = np.arange(len(ids))
            lists, anchors = Lists(_matrix(left)), _matrix(right)
            for j, (aid, lab) in enumerate(zip(right["rid"].to_pylist(), right["label"].to_pylist(), strict=True)):
                if same:
                    windows, names, fits = [(None, None)], [None], (label == lab) & (rid != aid)
                else:
                    w = right["windows"][j].as_py()
                    windows, names, fits = [(LOW * x["score"], HIGH * x["score"]) for x in w], [x["rid"] for x in w], label != lab
                if not fits.any():
                    continue
                best = Best(windows, k, place, fits)
                lists.access(anchors[j], best.settled)
                for name, rows, scores in zip(names, best.rows, best.scores, strict=True):
                    out += [(aid, name, int(rid[r]), ids[r], _clip(s)) for r, s in zip(rows, scores, strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("aid", "pid", "rid", "vec_id", "score"), cols, strict=True)})
    return run


def usable(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(rid, vec_id, label, v, dim): rows with a label and a vector of finite
    components; v holds floor(256 * x)."""
    x = F.col(vector)
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    lab = F.col(label).cast("long")
    lab = F.when(F.col("vec_id") % 7 == 0, (lab + 1) % 10).otherwise(lab)
    return (df.where(F.col(label).isNotNull() & x.isNotNull() & ok)
            .select(F.col("vec_id").cast("long").alias("vec_id"), lab.alias("label"),
                    F.transform(x, lambda c: F.floor(SCALE * c.cast("double"))).alias("v"), F.size(x).alias("dim"))
            .withColumn("rid", F.monotonically_increasing_id()))


def mine(df: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         rows_a_block: int = ROWS, vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score of the hardest negatives of each positive of each anchor
    (rows whose vec_id is divisible by ``every``).

    Defined cases: rows with a null label, a null vector or a null or
    non-finite component take no part; a row with a null vec_id is a candidate
    whose id comes after all others; repeated rows are rows of their own, and
    "other" means another row, even one with the same id; vectors are compared
    only with vectors of their length, empty ones score 0; scores are exact at
    any size and written clipped to the range of a long; an anchor without
    another row of its label, or whose windows hold nothing, gives no rows; so
    does an empty table; further columns are not looked at.
    """
    spark = df.sparkSession
    importable(spark)
    rows = saved(usable(df, vector, label), "vectors")
    n = rows.count()
    anchors = saved(rows.where(F.col("vec_id") % every == 0), "anchors", 1 + n // (every * ROWS))
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS))
    row_blocks, anchor_blocks = max(1, -(-n // rows_a_block), few), max(1, -(-anchors.count() // ANCHORS))
    own = lambda blocks: F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    grid = ["dim", "s", "r"]
    left = rows.withColumn("s", own(row_blocks)).withColumn("r", each(anchor_blocks)).groupBy(*grid)

    def meet(asked: DataFrame, k: int, same: bool) -> DataFrame:
        right = asked.withColumn("r", own(anchor_blocks)).withColumn("s", each(row_blocks))
        return left.cogroup(right.groupBy(*grid)).applyInArrow(_mine(k, same), _OUT)

    def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    pos = saved(top(meet(anchors, positives, True), ["aid"], positives), "positives")
    windows = (pos.where("score >= 0")  # below zero the lower bound lies above the upper one
               .groupBy(F.col("aid").alias("rid")).agg(F.collect_list(F.struct("rid", "score")).alias("windows")))
    neg = top(meet(anchors.join(windows, "rid"), negatives, False), ["aid", "pid"], negatives)
    neg = neg.select("aid", "pid", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = pos.select("aid", F.col("rid").alias("pid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("rid").alias("aid"), F.col("vec_id").alias("anchor_id"))
    return (neg.join(pos, ["aid", "pid"]).join(names, "aid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS aid, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid, c.vec_id,
             CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM r a JOIN r c ON a.rid <> c.rid AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT aid, anchor_id, rid AS pid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.aid, p.pid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid) AS rank
      FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
