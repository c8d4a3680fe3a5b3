"""Operator 12 against brute force, and that sorted access stops early."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leverkit.llm import negatives

ROW = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, npos=5, nneg=10):
    use = []
    for i, (v, x, lab) in enumerate(rows):
        if lab is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if v is not None and v % 7 == 0:
            lab = (lab + 1) % 10
        use.append((i, v, [math.floor(256 * c) for c in x], lab))
    place = lambda c: (-c[0], c[1] is None, c[1] or 0, c[2])
    out = []
    for i, v, x, lab in use:
        if v is None or v % every:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), w, j, other) for j, w, y, other in use if j != i and len(y) == len(x)]
        for ps, pid, *_ in sorted((s for s in scored if s[3] == lab), key=place)[:npos]:
            hit = sorted((s for s in scored if s[3] != lab and 30 * ps <= 100 * s[0] <= 90 * ps), key=place)[:nneg]
            out += [(v, pid, k, s[1], ps, s[0]) for k, s in enumerate(hit, 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(600):
        mid = r.randrange(5)
        out.append((i, [round(r.gauss(1.0 if d == mid else 0.0, 0.4), 2) for d in range(8)], r.choice([mid, r.randrange(10)])))
    out += [out[0], out[100], (100, out[3][1], 2), (None, out[200][1], 1), (None, out[300][1], 1), (700, [0.0] * 8, 3), (701, [0.0] * 8, 3), (800, [], 1), (801, [], 1), (802, [], 2),
            (900, [1.0, 2.0], 1), (901, [1.0, 1.5], 1), (902, [1.0, 1.0], 4), (1000, None, 1), (1100, [1.0] * 7 + [None], 1),
            (1200, [float("nan")] * 8, 1), (1300, [float("inf")] * 8, 1), (1400, [1.0] * 8, None), (-100, out[9][1], -3), (-7, out[8][1], -1)]
    out += [(2000 + k, [0.5, 0.25] + [0.0] * 6, k % 3) for k in range(40)]  # ties
    return out


@pytest.mark.parametrize("block", [negatives.ROWS, 60])
def test_negatives(spark, rows, block):
    df = spark.createDataFrame(rows, ROW).repartition(3).withColumns({c: F.lit(1) for c in ("rid", "v", "dim", "s", "r", "score", "rank", "windows")})
    got = sorted(map(tuple, negatives.mine(df, rows_a_block=block).collect()), key=repr)
    assert got == brute(rows) and len(got) > 200


def test_one_label_and_few_rows(spark):
    """A label that nearly all rows have, and fewer rows than asked for."""
    rows = [(i, [1.0 + i / 100, 1.0], 0 if i else 1) for i in range(0, 400)]
    df = spark.createDataFrame(rows, ROW)
    assert sorted(map(tuple, negatives.mine(df).collect()), key=repr) == brute(rows)
    assert negatives.mine(spark.createDataFrame([], ROW)).collect() == []
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], ROW)).collect() == []


def test_large_components(spark):
    """Scores past 2^53 are exact."""
    big = 2.0 ** 24
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big * 0.8, 3.0], 2), (3, [big * 0.8, 2.0], 2), (4, [big * 0.8, 3.0], 2)]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, ROW)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("sign", [1, -1])
def test_threshold_stops_early(sign):
    """With one strong dimension the best rows are found from a part of the lists."""
    rng = np.random.default_rng(1)
    v = np.rint(rng.normal(0, 3, (20_000, 6))).astype(np.int64)
    v[:, 0] = np.rint(rng.pareto(1.5, 20_000) * 50) * sign
    lists, anchor = negatives.Lists(v), np.array([40 * sign, 1, -1, 2, 0, 1])
    best = negatives.Best([(None, None)], 5, np.arange(len(v)), np.ones(len(v), bool))
    rows, depth = lists.access(anchor, best.settled)
    assert len(rows) < 2000 and depth < 1000
    score = v @ anchor
    assert best.rows[0].tolist() == np.lexsort((np.arange(len(v)), -score))[:5].tolist()


def test_threshold_tie_is_not_settled():
    """A row with the kth score and a smaller id that comes later is found."""
    v = np.array([[4, 0], [0, 4], [4, 0], [0, 4]] + [[-9, -9]] * 50)
    ids = np.array([9, 1, 8, 0, *range(10, 60)])
    best = negatives.Best([(None, None)], 2, ids, np.ones(len(v), bool))
    negatives.Lists(v).access(np.array([1, 1]), best.settled)
    assert ids[best.rows[0]].tolist() == [0, 1]


def test_planned_blocks(spark, rows):
    """Rows meet anchors in blocks: no cross join, no broadcast of rows."""
    plan = negatives.mine(spark.createDataFrame(rows, ROW))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
