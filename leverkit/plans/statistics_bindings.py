"""Queries of the persistence study's statistics and of densities, with their
oracles; conventions as in ``bindings``.

The oracles state the distribution of t by its finite trigonometric series
(integer degrees of freedom), which has nothing in common with the continued
fraction of the library, and its quantile by bisection.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import state as st
from ..operators import persist
from .bindings import _PRIOR_SQL, _STATE_SQL, _W, _events_as, _prior, _sql_cols, big, r4, register


def _area(t: str) -> str:
    """P(|T| <= t) with v degrees of freedom; ``coef`` lists the series."""
    c2 = f"(v / (v + {t} * {t}))"
    series = f"coalesce(list_sum(list_transform(coef, lambda c, k: c * pow({c2}, k - 1))), 0)"
    return (f"CASE WHEN v % 2 = 0 THEN sqrt(1 - {c2}) * {series} "
            f"ELSE 2 / pi() * (atan({t} / sqrt(v)) + sqrt((1 - {c2}) * {c2}) * {series}) END")


#: one row: the regression, v = n - 2, the series' coefficients, t of 95 percent
_LINE_SQL = f"""{_PRIOR_SQL},
g AS (SELECT regr_count(spend, prev_spend) AS n, regr_slope(spend, prev_spend) AS b, regr_intercept(spend, prev_spend) AS a,
        regr_r2(spend, prev_spend) AS r2, regr_sxx(spend, prev_spend) AS sxx, regr_syy(spend, prev_spend) AS syy,
        regr_avgx(spend, prev_spend) AS mx FROM p),
e AS (SELECT *, CAST(n - 2 AS BIGINT) AS v, sqrt((syy - b * b * sxx) / (n - 2)) AS sigma FROM g),
k AS (SELECT k, exp(sum(CASE WHEN k = 0 THEN 0 WHEN v % 2 = 0 THEN ln((2.0 * k - 1) / (2 * k)) ELSE ln(2.0 * k / (2 * k + 1)) END)
        OVER (ORDER BY k)) AS c FROM (SELECT v, unnest(range(CASE WHEN v % 2 = 0 THEN v // 2 ELSE (v - 1) // 2 END)) AS k FROM e)),
l AS (SELECT *, (SELECT coalesce(list(c ORDER BY k), []) FROM k) AS coef, sigma / sqrt(sxx) AS se_b,
        sigma * sqrt(1.0 / n + mx * mx / sxx) AS se_a FROM e),
q(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1000 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN area < 0.95 THEN mid ELSE lo END, CASE WHEN area < 0.95 THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, {_area('mid')} AS area FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM q WHERE i < 60), l)),
s AS (SELECT *, (SELECT (lo + hi) / 2 FROM q WHERE i = 60) AS t95 FROM l)"""
_R4 = lambda x, name: f"round({x}, 4) + 0.0 AS {name}"


@register("stickiness_pvalue", f"""WITH RECURSIVE {_LINE_SQL},
t AS (SELECT *, b / se_b AS tb, a / se_a AS ta FROM s)
SELECT CAST(n AS BIGINT) AS n, {_R4('b', 'slope')}, {_R4('a', 'intercept')}, {_R4('se_b', 'se_slope')}, {_R4('se_a', 'se_intercept')},
       {_R4('tb', 't_slope')}, {_R4('ta', 't_intercept')}, {_R4('1 - (' + _area('abs(tb)') + ')', 'p_slope')},
       {_R4('1 - (' + _area('abs(ta)') + ')', 'p_intercept')}, {_R4('sigma', 'sigma')}, {_R4('r2', 'r2')},
       {_R4('1 - (1 - r2) * (n - 1) / (n - 2)', 'adj_r2')}, {_R4('t95', 't_level')} FROM t""")
def q_stickiness_p(spark, d):
    s = persist.ols_summary(_prior(spark, d), "prev_spend", "spend")
    names = ["slope", "intercept", "se_slope", "se_intercept", "t_slope", "t_intercept", "p_slope", "p_intercept", "sigma", "r2", "adj_r2", "t_level"]
    return s.select(big("n").alias("n"), *[r4(c).alias(c) for c in names])


_BAND = "t95 * sigma * sqrt(1.0 / s.n + (prev_spend - mx) * (prev_spend - mx) / sxx)"


@register("persistence_band", f"""WITH RECURSIVE {_LINE_SQL}
SELECT o_custkey, CAST(season AS BIGINT) AS season, {_R4('a + b * prev_spend', 'fit')},
       {_R4('a + b * prev_spend - ' + _BAND, 'fit_low')}, {_R4('a + b * prev_spend + ' + _BAND, 'fit_high')} FROM p, s""")
def q_persistence_band(spark, d):
    x = persist.regression_band(_prior(spark, d), "prev_spend", "spend")
    return x.select("o_custkey", big("season").alias("season"), *[r4(c).alias(c) for c in ("fit", "fit_low", "fit_high")])


# ------------------------------------------------ M9: densities of a model value by state and outs
def _density_sql(source: str, facets: str, n: int) -> str:
    same = lambda a, b: " AND ".join(f"{a}.{f.strip()} = {b}.{f.strip()}" for f in facets.split(","))
    return f"""{source},
r AS (SELECT min(x) AS lo, (max(x) - min(x)) / {n - 1} AS step FROM v),
m AS (SELECT {facets}, count(*) AS n_values, 0.9 * pow(count(*), -0.2) * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) AS bw,
        0.9 * pow(count(*), -0.2) * stddev_samp(x) AS wide FROM v GROUP BY {facets} HAVING count(*) > 1),
f AS (SELECT * REPLACE (CASE WHEN bw = 0 THEN wide ELSE bw END AS bw) FROM m),
c AS (SELECT {facets}, least(floor((x - lo) / step), {n - 2}) AS i, (x - lo) / step AS pos FROM v, r),
w AS (SELECT {facets}, i AS i, sum(1 - (pos - i)) AS w FROM c GROUP BY {facets}, i UNION ALL SELECT {facets}, i + 1, sum(pos - i) FROM c GROUP BY {facets}, i),
b AS (SELECT {facets}, i, sum(w) AS w FROM w GROUP BY {facets}, i),
g AS (SELECT f.*, unnest(range({n})) AS point FROM f),
s AS (SELECT g.*, (SELECT sum(w * exp(-0.5 * pow((g.point - b.i) * r.step / g.bw, 2))) FROM b WHERE {same('b', 'g')}) AS s, lo, step FROM g, r)
SELECT {facets}, CAST(point AS BIGINT) AS point, {_R4('lo + point * step', 'x')}, {_R4('s / (n_values * bw * sqrt(2 * pi()))', 'density')},
       {_R4('bw', 'bandwidth')}, CAST(n_values AS BIGINT) AS n_values FROM s"""


def _density_out(out, facets):
    return out.select(*facets, big("point").alias("point"), r4("x").alias("x"), r4("density").alias("density"),
                      r4("bandwidth").alias("bandwidth"), big("n_values").alias("n_values"))


def _run_values(spark, d):
    x = _events_as(spark, d, _W)
    return x.select(st.base_state("on_1b", "on_2b", "on_3b").alias("base_state"), big(F.col("event_id") % 3).alias("outs"),
                    (F.col("xr") + 0.5).alias("x"))


_VALUES_SQL = f"e AS (SELECT {_sql_cols(_W, ['event_id'])} FROM events), a AS (SELECT {_STATE_SQL} AS base_state, CAST(event_id % 3 AS BIGINT) AS outs, xr + 0.5 AS x FROM e)"


@register("density", "WITH " + _density_sql(
    f"{_VALUES_SQL}, v AS (SELECT base_state, outs, greatest(0, least(4, x)) AS x FROM a WHERE x IS NOT NULL)", "base_state, outs", 512))
def q_density(spark, d):
    """The published panels: the value kept to 0..4, by base state and outs."""
    x = _run_values(spark, d).withColumn("x", F.greatest(F.lit(0.0), F.least(F.lit(4.0), "x"))).where("x IS NOT NULL")
    return _density_out(persist.kernel_density(x, ["base_state", "outs"], "x"), ["base_state", "outs"])


_SUBSETS = {"all": "true", "runners": "base_state <> '___'", "loaded": "base_state = '321'"}


@register("density_subsets", "WITH " + _density_sql(f"{_VALUES_SQL}, v AS ({' UNION ALL '.join(
    f"SELECT '{k}' AS subset, x FROM a WHERE x IS NOT NULL AND {c}" for k, c in _SUBSETS.items())})", "subset", 512))
def q_density_subsets(spark, d):
    """The whole value and two subsets of it, on one grid."""
    names = F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in _SUBSETS.items()])
    x = _run_values(spark, d).withColumn("subset", F.explode(F.array_compact(names)))
    return _density_out(persist.kernel_density(x, ["subset"], "x"), ["subset"])
