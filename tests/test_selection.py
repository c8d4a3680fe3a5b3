"""Distributed selection against sorting, and the split's plan."""
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from leverkit.operators.verbs import stratified_split
from leverkit.plans.selection import digest_cuts


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


@pytest.mark.parametrize("how,share", [({}, 0.65), ({}, 0.0), ({}, 1.0), ({"digits": 8, "left": 0}, 0.3), ({"digits": 3, "left": 8}, 0.65), ({"digits": 32}, 0.3)])
def test_cuts(spark, how, share):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), md5(i)) for i in range(400)] + [("one", md5("x"))]
    rows += [("same", md5("dup"))] * 10 + [("mixed", d) for d in [md5("dup")] * 6 + sorted(md5(i) for i in range(6))]
    df = spark.createDataFrame(rows, "g string, d string")
    cuts = {x.g: (x._n, x._cut) for x in digest_cuts(df, ["g"], "d", share, **how).collect()}
    for g in {g for g, _ in rows}:
        mine = sorted(d for h, d in rows if h == g)
        k = math.floor(len(mine) * share)
        assert cuts[g][0] == len(mine)
        taken = [d for d in mine if d <= cuts[g][1]]
        # as many as fit: all copies of a digest, or none
        want = [d for d in mine if sum(x <= d for x in mine) <= k]
        assert taken == want


def test_split_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("s"))
    a = stratified_split(df, ["k"], "s", 0.65)
    b = stratified_split(df.repartition(5), ["k"], "s", 0.65)
    assert a.exceptAll(b).count() == 0
    for x in a.groupBy("s").agg(F.count("*").alias("n"), F.sum("is_train").alias("t")).collect():
        assert x.t == math.floor(x.n * 0.65)
    assert stratified_split(df.where("k < 0"), ["k"], "s", 0.65).count() == 0


def test_split_moves_no_rows(spark):
    """The rows meet the cuts in a broadcast join: no exchange but that of the
    cuts, no sort, no window."""
    df = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    out = stratified_split(df, ["k"], "s", 0.65)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan
