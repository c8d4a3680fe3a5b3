"""Runs saved above expectation (RSAE / xRSAE) at game and season grain."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite, safe_div, strict_sum
from ..plans.ordered import exact_quantiles, row_number_in_group
from .verbs import center as center_cols
from .verbs import join_keys_null_safe


def runs_saved(df: DataFrame, runs_bs: str, runs_allowed: str, exp_runs: str,
               actual: str = "actual_rapo", expected: str = "expected_rapo") -> DataFrame:
    """actual = expected-from-state - allowed; expected = expected-from-state
    - expected-from-statline."""
    return df.withColumns({actual: F.col(runs_bs) - F.col(runs_allowed),
                           expected: F.col(runs_bs) - F.col(exp_runs)})


def season_runs_saved(df: DataFrame, entity: str, game: str, season: str, outs: str,
                      actual: str = "actual_rapo", expected: str = "expected_rapo",
                      min_appearances: int = 25, keep_outs: bool = False,
                      lookup: DataFrame | None = None) -> DataFrame:
    """Game sums, then per (entity, season): games, and saved runs per 3 outs.

    Sums are strict (one NULL input makes the sum NULL, as in the source),
    seasons with ``min_appearances`` or fewer games are dropped, and a
    non-finite rate (no outs recorded) drops the season.  ``lookup`` (a
    table unique on ``entity``) adds names.
    """
    g = df.groupBy(entity, game, season).agg(
        strict_sum(actual).alias("_a"), strict_sum(expected).alias("_e"),
        strict_sum(outs).alias("_o"))
    s = g.groupBy(entity, season).agg(
        F.count(F.lit(1)).alias("appearances"),
        strict_sum("_o").alias("_so"), strict_sum("_a").alias("_sa"),
        strict_sum("_e").alias("_se"))
    s = s.withColumns({"actual_rapo_season": safe_div("_sa", "_so") * 3,
                       "expected_rapo_season": safe_div("_se", "_so") * 3})
    s = s.where(F.col("appearances") > min_appearances)
    s = s.where(finite("actual_rapo_season") & finite("expected_rapo_season"))
    if keep_outs:
        s = s.withColumn("outs_made", F.col("_so"))
    s = s.drop("_so", "_sa", "_se")
    if lookup is not None:
        # broadcast or not is Spark's size-checked decision (plan estimate,
        # then AQE's runtime statistics against the broadcast threshold)
        s = s.join(lookup, entity, "left")
    return s


def trim_open_quantiles(df: DataFrame, by: Sequence[str], value: str,
                        lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Keep rows strictly inside the (lo, hi) type-7 quantiles of ``value``
    within each group (a group of one row, or of equal values, vanishes); a
    NULL key is a group."""
    q = exact_quantiles(df, list(by), value, {"_qlo": lo, "_qhi": hi})
    return (join_keys_null_safe(df, q, list(by), "left")
              .where((F.col(value) < F.col("_qhi")) & (F.col(value) > F.col("_qlo")))
              .drop("_qlo", "_qhi"))


def trimmed_season_runs_saved(df: DataFrame, entity: str, game: str, season: str,
                              outs: str, actual: str = "actual_rapo",
                              expected: str = "expected_rapo",
                              by: Sequence[str] | None = None, center: bool = False,
                              lo: float = 0.05, hi: float = 0.95,
                              min_appearances: int = 25,
                              lookup: DataFrame | None = None) -> DataFrame:
    """Season runs saved after dropping each group's extreme appearances.

    Rows outside the open (lo, hi) quantile interval of ``actual`` within
    ``by`` (default (entity, season)) are dropped first; then the season
    roll-up runs with the outs total kept, and ``diff`` = actual - expected.
    ``center`` first subtracts the table means of both values.
    """
    x = center_cols(df, [actual, expected]) if center else df
    x = trim_open_quantiles(x, by or [entity, season], actual, lo, hi)
    s = season_runs_saved(x, entity, game, season, outs, actual, expected,
                          min_appearances, keep_outs=True, lookup=lookup)
    return s.withColumn("diff", F.col("actual_rapo_season") - F.col("expected_rapo_season"))


def season_order(df: DataFrame, entity: str, season: str, metric: str, name: str) -> DataFrame:
    """The published order of a season table as an explicit column: latest
    season first, then the best ``metric`` (NULL last), then the entity."""
    x = df.withColumns({"_s": -F.col(season), "_null": F.col(metric).isNull(), "_m": -F.col(metric)})
    return row_number_in_group(x, [], ["_s", "_null", "_m", entity], name).drop("_s", "_null", "_m")


def state_mean(df: DataFrame, state_cols: Sequence[str], value: str,
               name: str = "state_mean") -> DataFrame:
    """Mean of a model value per game state (e.g. base state x outs)."""
    return df.groupBy(*state_cols).agg(F.avg(value).alias(name))
