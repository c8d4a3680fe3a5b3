"""Year-to-year persistence of a season metric, its line and tests, overrides,
and the distribution of a value: histograms and densities."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_quantile, t_two_sided
from ..plans.ordered import exact_quantiles, lag_bounded
from ..session import materialize
from .verbs import join_keys_null_safe, scalar_aggs, scalar_aggs_of


def prior_season_lag(df: DataFrame, entity: str, season: str, cols: Sequence[str],
                     prefix: str = "prev_", consecutive_only: bool = False) -> DataFrame:
    """Previous row's value per entity in season order (a skipped season is
    not a gap unless ``consecutive_only``).  One row per entity-season, so
    the groups are bounded by the number of seasons."""
    out = df
    for c in cols:
        out = lag_bounded(out, [entity], [season], c, 1, f"{prefix}{c}")
    if consecutive_only:
        out = lag_bounded(out, [entity], [season], season, 1, "_prev_season")
        gap = F.col(season) - F.col("_prev_season") != 1
        out = out.withColumns({f"{prefix}{c}": F.when(gap, None).otherwise(F.col(f"{prefix}{c}"))
                               for c in cols}).drop("_prev_season")
    return out


def stickiness(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairwise-complete correlation and OLS of y on x, one row."""
    return df.agg(F.regr_count(y, x).alias("n"),
                  F.regr_slope(y, x).alias("slope"),
                  F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"),
                  F.corr(x, y).alias("r"))


def ols_summary(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    """The summary of the least-squares line y ~ x over the complete pairs, as
    one row from one aggregate: coefficients with standard errors, t values and
    two-sided p values, residual error, R2, the F test, and what a confidence
    band needs (``x_mean``, ``sxx`` and the t quantile of ``level``).

    Fewer than three pairs, or a constant x, leave the tests NULL.
    """
    a = df.agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
               F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_avgx(y, x).alias("x_mean"))
    free = F.when(F.col("n") > 2, F.col("n") - 2)
    a = a.withColumn("df", free).withColumn("sigma", F.sqrt(F.col("_syy") * (1 - F.col("r2")) / F.col("df")))
    a = a.withColumns({"se_slope": F.try_divide("sigma", F.sqrt("sxx")),
                       "se_intercept": F.col("sigma") * F.sqrt(1 / F.col("n") + F.try_divide(F.col("x_mean") ** 2, F.col("sxx")))})
    a = a.withColumns({f"t_{c}": F.try_divide(c, f"se_{c}") for c in ("slope", "intercept")})
    a = a.withColumns({f"p_{c}": t_two_sided(f"t_{c}", "df") for c in ("slope", "intercept")})
    a = a.withColumns({"adj_r2": 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.col("df"), "f": F.col("t_slope") ** 2,
                       "t_level": t_quantile(level, "df")})
    # one regressor: the F test is the t test of the slope
    return a.withColumn("p_f", F.col("p_slope")).drop("_syy")


def slope_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope of y on x, its standard error, t and p value, r2."""
    return ols_summary(df, x, y).select("n", "slope", "se_slope", "t_slope", "p_slope", "r2")


def regression_band(df: DataFrame, x: str, y: str, level: float = 0.95, prefix: str = "fit") -> DataFrame:
    """The fitted line y ~ x at each row's x, with the ``level`` confidence
    band of the mean: ``<prefix>``, ``<prefix>_low``, ``<prefix>_high`` (NULL
    without an x).  The summary is one written row, read as a scalar subquery: nothing is joined."""
    s = scalar_aggs_of(materialize(ols_summary(df, x, y, level)))
    at = F.col(x)
    mid = s["intercept"] + s["slope"] * at
    half = s["t_level"] * s["sigma"] * F.sqrt(1 / s["n"] + F.try_divide((at - s["x_mean"]) ** 2, s["sxx"]))
    return df.withColumns({prefix: mid, f"{prefix}_low": mid - half, f"{prefix}_high": mid + half})


def point_override(df: DataFrame, match: dict, col: str, value) -> DataFrame:
    """Replace ``col`` by ``value`` on rows matching every key in ``match``."""
    cond = None
    for k, v in match.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))


def histogram(df: DataFrame, facets: Sequence[str], col: str, lo: float, hi: float,
              n: int, name: str = "bucket") -> DataFrame:
    """Counts per facet and equal-width bucket (0 below ``lo``, n+1 at or
    above ``hi``; NULL values are skipped)."""
    b = F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(n))
    return (df.where(F.col(col).isNotNull()).withColumn(name, b)
              .groupBy(*facets, name).agg(F.count(F.lit(1)).alias("n")))


#: grid points further than this many bandwidths from a bin get nothing from it
#: (less than 1e-17 of its peak)
REACH = 9.0


def bandwidth(n, deviation, q1, q3, value) -> Column:
    """The rule of thumb for a Gaussian kernel: 0.9 n^(-1/5) times the smaller
    of the deviation and the interquartile range over 1.34; where that is zero
    the deviation, else the size of the (only) value, else 1."""
    spread = F.least(deviation, (q3 - q1) / 1.34)
    for other in (deviation, F.abs(value), F.lit(1.0)):
        spread = F.when(spread == 0, other).otherwise(spread)
    return 0.9 * spread * F.pow(n, F.lit(-0.2))


def kernel_density(df: DataFrame, facets: Sequence[str], col: str, n: int = 512,
                   lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Gaussian kernel density of ``col`` per facet on one grid of ``n`` points
    from ``lo`` to ``hi`` (default: the range of all rows).

    One row a facet and grid point: ``point`` (from 0), ``x``, ``density``,
    ``bandwidth`` and ``n_values``.  Values are dealt to the two grid points
    beside them by their distance (linear binning), which leaves at most ``n``
    weights a facet however many rows there are; the Gaussian is summed over
    those.  The bandwidth of a facet comes from its deviation and exact
    quartiles.  Values that are NULL, not finite or outside the grid are left
    out, as are facets with fewer than two values.
    """
    if not facets:
        return kernel_density(df.withColumn("_all", F.lit(0)), ["_all"], col, n, lo, hi).drop("_all")
    facets = list(facets)
    c = F.col(col).cast("double")
    v = df.select(*facets, c.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    if lo is not None:
        v = v.where(F.col("_x") >= lo)
    if hi is not None:
        v = v.where(F.col("_x") <= hi)
    r = scalar_aggs(v, {"lo": F.min("_x"), "hi": F.max("_x")})
    left, right = (F.lit(float(x)) if x is not None else r[k] for k, x in (("lo", lo), ("hi", hi)))
    # a single value everywhere still gets a grid around it
    left, right = F.when(left == right, left - 0.5).otherwise(left), F.when(left == right, right + 0.5).otherwise(right)
    step = (right - left) / (n - 1)
    moments = v.groupBy(*facets).agg(F.count("*").alias("n_values"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_v")).where("n_values > 1")
    quarts = exact_quantiles(v, facets, "_x", {"_q1": 0.25, "_q3": 0.75})
    stats = join_keys_null_safe(moments, quarts, facets, "inner")
    stats = materialize(stats.select(*facets, "n_values", left.alias("_lo"), step.alias("_step"),
                                     bandwidth(F.col("n_values"), F.col("_sd"), F.col("_q1"), F.col("_q3"), F.col("_v")).alias("bandwidth")))
    pos = (F.col("_x") - left) / step
    cell = F.greatest(F.lit(0), F.least(F.floor(pos), F.lit(n - 2))).cast("int")
    bins = v.withColumns({"_cell": cell, "_far": pos - cell}).groupBy(*facets, "_cell").agg(F.sum(1 - F.col("_far")).alias("_near"), F.sum("_far").alias("_far"))
    bins = bins.select(*facets, F.explode(F.array(F.struct(F.col("_cell").alias("b"), F.col("_near").alias("w")),
                                                  F.struct((F.col("_cell") + 1).alias("b"), F.col("_far").alias("w")))).alias("_c"))
    bins = bins.groupBy(*facets, F.col("_c.b").alias("_bin")).agg(F.sum("_c.w").alias("_w")).where("_w <> 0")
    bins = join_keys_null_safe(bins, stats, facets, "inner")
    span = F.ceil(REACH * F.col("bandwidth") / F.col("_step")).cast("int")
    near = F.sequence(F.greatest(F.lit(0), F.col("_bin") - span), F.least(F.lit(n - 1), F.col("_bin") + span))
    z = (F.col("point") - F.col("_bin")) * F.col("_step") / F.col("bandwidth")
    sums = (bins.withColumn("point", F.explode(near)).groupBy(*facets, "point")
            .agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("_sum")))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = join_keys_null_safe(grid, sums, [*facets, "point"], "left")
    density = F.coalesce("_sum", F.lit(0.0)) / (F.col("n_values") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return out.select(*facets, "point", (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"), density.alias("density"), "bandwidth", "n_values")
