"""Special functions, the line's tests and band, kernel densities."""
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from leverkit.functions import special
from leverkit.operators import persist


def t_area(t, v):
    """P(|T| <= t) by the finite series for a whole number of degrees of freedom."""
    th = math.atan(t / math.sqrt(v))
    c, total, term = math.cos(th) ** 2, 0.0, 1.0
    if v % 2 == 0:
        for k in range(v // 2):
            total += term * c ** k
            term *= (2 * k + 1) / (2 * k + 2)
        return math.sin(th) * total
    for k in range((v - 1) // 2):
        total += term * c ** k
        term *= (2 * k + 2) / (2 * k + 3)
    return 2 / math.pi * (th + math.sin(th) * math.cos(th) * total)


def test_t_tail(spark):
    rows = [(t, v) for t in (0.0, 0.001, 0.5, 1.0, 2.5, 12.7, 40.0) for v in (1, 2, 3, 10, 31, 1000)]
    df = spark.createDataFrame(rows, "t double, v int")
    for r in df.select("t", "v", special.t_two_sided("t", "v").alias("p"), special.t_two_sided("-t", "v").alias("q")).collect():
        assert r.p == r.q and math.isclose(r.p, 1 - t_area(r.t, r.v), abs_tol=1e-11), r
    far = df.limit(1).select(special.t_two_sided(1.959963984540054, 1e9)).first()[0]
    assert math.isclose(far, 0.05, rel_tol=1e-6)


def test_beta_gamma(spark):
    one = spark.range(1)
    for x in (0.01, 0.5, 1.0, 7.25, 1e3, 1e7):
        assert math.isclose(one.select(special.log_gamma(x)).first()[0], math.lgamma(x), rel_tol=1e-12, abs_tol=1e-10)
    # I_x(a, b) for whole a, b is a binomial tail; and the two ends
    for a, b, x in ((2, 3, 0.3), (5, 1, 0.9), (20, 30, 0.4), (1, 1, 0.25)):
        n = a + b - 1
        want = sum(math.comb(n, j) * x ** j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert math.isclose(one.select(special.beta_inc(a, b, x)).first()[0], want, rel_tol=1e-11)
    got = one.select(special.beta_inc(2, 3, 0.0), special.beta_inc(2, 3, 1.0), special.beta_inc(2, 3, 1.5), special.beta_inc(-1, 3, 0.5)).first()
    assert tuple(got) == (0.0, 1.0, None, None)


def test_t_quantile(spark):
    df = spark.createDataFrame([(lv, v) for lv in (0.5, 0.95, 0.999) for v in (1, 2, 5, 30, 999)], "lv double, v int")
    for r in df.select("lv", "v", special.t_quantile("lv", "v").alias("t")).collect():
        assert math.isclose(t_area(r.t, r.v), r.lv, rel_tol=1e-9), r


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(8)
    rows = [(i, x := r.gauss(5, 2), 1.5 - 0.4 * x + r.gauss(0, 1)) for i in range(40)] + [(90, None, 1.0), (91, 1.0, None)]
    return rows, spark.createDataFrame(rows, "k int, x double, y double")


def test_ols_summary(spark, pairs):
    rows, df = pairs
    pts = [(x, y) for _, x, y in rows if x is not None and y is not None]
    n, mx = len(pts), statistics.mean(x for x, _ in pts)
    sxx = sum((x - mx) ** 2 for x, _ in pts)
    b = sum((x - mx) * y for x, y in pts) / sxx
    a = statistics.mean(y for _, y in pts) - b * mx
    rss = sum((y - a - b * x) ** 2 for x, y in pts)
    sigma = math.sqrt(rss / (n - 2))
    s = persist.ols_summary(df, "x", "y").first()
    assert s.n == n and math.isclose(s.slope, b) and math.isclose(s.intercept, a) and math.isclose(s.sigma, sigma)
    assert math.isclose(s.se_intercept, sigma * math.sqrt(1 / n + mx * mx / sxx))
    assert math.isclose(s.p_slope, 1 - t_area(abs(s.t_slope), n - 2), rel_tol=1e-8, abs_tol=1e-12)
    assert math.isclose(s.p_f, s.p_slope, rel_tol=1e-9)  # one regressor: F is t squared
    band = {r.k: r for r in persist.regression_band(df, "x", "y").collect()}
    assert band[90].fit is None and math.isclose(band[91].fit, a + b)
    for k, x, _ in rows[:40]:
        half = s.t_level * sigma * math.sqrt(1 / n + (x - mx) ** 2 / sxx)
        assert math.isclose(band[k].fit_low, a + b * x - half) and math.isclose(band[k].fit_high, a + b * x + half)


@pytest.mark.parametrize("rows", [[], [(0, 1.0, 2.0)], [(0, 1.0, 2.0), (1, 2.0, 3.0)], [(i, 1.0, float(i)) for i in range(5)]])
def test_ols_without_enough(spark, rows):
    s = persist.ols_summary(spark.createDataFrame(rows, "k int, x double, y double"), "x", "y").first()
    assert s.n == len(rows) and s.p_slope is None


def brute_density(values, at, bw):
    return sum(math.exp(-0.5 * ((at - v) / bw) ** 2) for v in values) / (len(values) * bw * math.sqrt(2 * math.pi))


def test_kernel_density(spark):
    r = random.Random(5)
    groups = {"a": [r.gauss(0, 1) for _ in range(300)], None: [r.choice([1.0, 2.0, 2.5]) for _ in range(50)], "flat": [3.0] * 20,
              "one": [1.0], "zero": [0.0] * 5, "mostly": [1.0] * 30 + [2.0, 0.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", float("inf"))]
    out = persist.kernel_density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", n=400).collect()
    assert {x.g for x in out} == set(groups) - {"one"} and len(out) == 5 * 400
    for g, vs in groups.items():
        mine = sorted((x for x in out if x.g == g), key=lambda x: x.point)
        if not mine:
            continue
        bw = mine[0].bandwidth
        q = statistics.quantiles(vs, n=4, method="inclusive")
        spread = min(statistics.stdev(vs), (q[2] - q[0]) / 1.34) or statistics.stdev(vs) or abs(vs[0]) or 1.0
        assert math.isclose(bw, 0.9 * spread * len(vs) ** -0.2) and mine[0].n_values == len(vs)
        step = mine[1].x - mine[0].x
        peak = max(x.density for x in mine)
        # linear binning is off by the square of the step over the bandwidth
        worst = max(abs(x.density - brute_density(vs, x.x, bw)) for x in mine)
        assert worst < peak * (step / bw) ** 2 / 4 + 1e-12


def test_density_without_facets(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double")
    out = persist.kernel_density(df, [], "v", n=64, lo=-5.0, hi=12.0).orderBy("point").collect()
    assert len(out) == 64 and (out[0].x, out[-1].x) == (-5.0, 12.0)
    assert math.isclose(sum(x.density for x in out) * (17 / 63), 1.0, rel_tol=1e-3)
    assert persist.kernel_density(df.where("v > 99"), [], "v").count() == 0
    assert {x.x for x in persist.kernel_density(df.withColumn("v", F.lit(2.0)), [], "v", n=3).collect()} == {1.5, 2.0, 2.5}
