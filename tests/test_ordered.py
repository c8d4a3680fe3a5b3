"""The split-safe ordered primitives equal the plain windows, whatever the
group-size limit (property test over random skewed tables)."""
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import Window
from pyspark.sql import functions as F

from leverkit.plans import ordered


def _table(spark, seed, n, hot_share):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if rnd.random() < hot_share else rnd.randint(1, 6)
        rows.append((g, rnd.randint(0, 40), i, rnd.choice([None, rnd.random()])))
    return spark.createDataFrame(rows, "g int, t int, id int, v double")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=hs.integers(0, 10_000), limit=hs.sampled_from([1, 3, 17]),
       hot=hs.sampled_from([0.0, 0.34, 0.9]))
def test_lead_and_row_number_equal_plain_window(spark, seed, limit, hot):
    df = _table(spark, seed, 120, hot)
    w = Window.partitionBy("g").orderBy("t", "id")
    plain = df.withColumn("next_v", F.lead("v").over(w)).withColumn("next_id", F.lead("id").over(w)) \
              .withColumn("rn", F.row_number().over(w))
    a = ordered.lead_in_group(df, ["g"], ["t", "id"], ["v", "id"], max_rows=limit)
    a = ordered.row_number_in_group(a, ["g"], ["t", "id"], "rn", max_rows=limit)
    got = {r.id: (r.next_v, r.next_id, r.rn) for r in a.collect()}
    exp = {r.id: (r.next_v, r.next_id, r.rn) for r in plain.collect()}
    assert got == exp


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_whole_table_lead(spark, limit):
    df = _table(spark, 7, 80, 0.5)
    w = Window.orderBy("g", "t", "id")
    exp = {r.id: r.next_id for r in df.withColumn("next_id", F.lead("id").over(w)).collect()}
    got = ordered.lead_in_group(df, [], ["g", "t", "id"], ["id"], max_rows=limit)
    assert {r.id: r.next_id for r in got.collect()} == exp


@pytest.mark.parametrize("limit", [2, 1000])
def test_exact_quantiles_match_percentile(spark, limit):
    df = _table(spark, 11, 150, 0.6)
    exp = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(
        F.percentile("v", 0.05).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    got = {r.g: (r.a, r.b) for r in ordered.exact_quantiles(
        df, ["g"], "v", {"a": 0.05, "b": 0.95}, max_rows=limit).collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        for x, y in zip(got[k], exp[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-12


HARD = {
    "constant first column": lambda i, r: (0, "same", f"k{i:04d}"),
    "long common prefix": lambda i, r: (0, f"Customer#{'0' * 30}{i:05d}", "x"),
    "null group": lambda i, r: (None, f"a{i:04d}", "x"),
    "null order": lambda i, r: (0, None, f"k{i:04d}"),
    "two hot groups": lambda i, r: (r.choice([0, None]), r.choice(["p", None]), f"k{i:04d}"),
    "ties but for the last column": lambda i, r: (r.randint(0, 1), "t", f"{r.randint(0, 9)}-{i:04d}"),
}


@pytest.mark.parametrize("kind", HARD)
def test_hard_groups_split_and_stay_exact(spark, kind):
    rnd = random.Random(kind)
    rows = [(*HARD[kind](i, rnd), i) for i in range(240)] + [(9, "z", "z", 999)]
    df = spark.createDataFrame(rows, "g int, a string, b string, id int").repartition(3)
    order = ["a", "b"]
    w = Window.partitionBy("g").orderBy(*order)
    exp = {r.id: (r.n, r.rn) for r in df.withColumn("n", F.lead("id").over(w)).withColumn("rn", F.row_number().over(w)).collect()}
    x = ordered.lead_in_group(df, ["g"], order, ["id"], max_rows=20, last_flag="last", group_aggs={"m": F.max("id")})
    got = x.collect()
    assert {r.id: r.next_id for r in got} == {k: v[0] for k, v in exp.items()}
    assert all(r.last == (exp[r.id][0] is None) for r in got)
    top = {g: max(r[3] for r in rows if r[0] == g) for g in {r[0] for r in rows}}
    assert all(r.m == top[r.g] for r in got)
    y = ordered.row_number_in_group(df, ["g"], order, "rn", max_rows=20)
    assert y.schema["rn"].dataType.simpleString() == "bigint"
    assert {r.id: r.rn for r in y.collect()} == {k: v[1] for k, v in exp.items()}
    # no range, so no task of the window, holds much more than the limit
    sizes = [r["count"] for r in ordered._Ranges(df, ["g"], order, 20).rows.groupBy("_p").count().collect()]
    assert max(sizes) <= 4 * 20


def test_heavy_plan_broadcasts_one_row_a_range(spark):
    df = _table(spark, 21, 100, 0.5)
    out = ordered.lead_in_group(df, ["g"], ["t", "id"], ["v"], max_rows=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "RepartitionByExpression" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=hs.integers(0, 10_000), limit=hs.sampled_from([1, 4, 30]),
       hot=hs.sampled_from([0.3, 0.9]))
def test_exact_quantiles_selection_property(spark, seed, limit, hot):
    rnd = random.Random(seed)
    rows = [(0 if rnd.random() < hot else rnd.randint(1, 4),
             rnd.choice([None, float(rnd.randint(0, 9)), rnd.random()])) for _ in range(160)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    exp = {r.g: tuple(r[k] for k in probs) for r in df.groupBy("g").agg(
        *[F.percentile("v", p).alias(k) for k, p in probs.items()]).collect()}
    got = {r.g: tuple(r[k] for k in probs) for r in ordered.exact_quantiles(
        df, ["g"], "v", probs, max_rows=limit).collect()}
    assert got.keys() == exp.keys()
    for g in exp:
        for x, y in zip(got[g], exp[g]):
            assert (x is None and y is None) or abs(x - y) < 1e-12, (g, got[g], exp[g])


def test_exact_quantiles_with_a_huge_tie(spark):
    rows = [(0, 0.0)] * 300 + [(0, float(i)) for i in range(1, 40)] + [(1, 2.0), (1, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"a": 0.05, "b": 0.5, "c": 0.9, "d": 0.99}
    exp = {r.g: tuple(r[k] for k in probs) for r in df.groupBy("g").agg(
        *[F.percentile("v", p).alias(k) for k, p in probs.items()]).collect()}
    got = {r.g: tuple(r[k] for k in probs) for r in ordered.exact_quantiles(
        df, ["g"], "v", probs, max_rows=10).collect()}
    assert got == exp
