"""Rest between outings, rest profiles and their Shannon entropy."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div, zsum
from ..session import materialize
from ..plans.ordered import lag_bounded, row_number_in_group
from .verbs import (group_filter_not_min, pivot_fixed, scalar_aggs,
                    semi_by_values)

# --- fixed values: rest labels for -1 .. 10 days of rest, in order
REST_LABELS = ["B2B2B", "B2B", "OneDay", "TwoDay", "ThreeDay", "FourDay", "FiveDay",
               "SixDay", "SevenDay", "EightDay", "NineDay", "TenDay"]
REST_VALUES = list(range(-1, 11))


def outings(df: DataFrame, entity: str, date: str, game: str, season: str) -> DataFrame:
    """Distinct (date, game, entity, season) rows."""
    return df.select(date, game, entity, season).distinct()


def unify_outings(primary: DataFrame, secondary: DataFrame, entity: str,
                  secondary_entity: str | None = None) -> DataFrame:
    """Outings of the primary league plus the secondary league's outings of
    the same entities (row-bound by name; missing columns become NULL).

    Each side is de-duplicated on its own, the union is not (the two
    sources' game ids are disjoint).
    """
    sec = secondary
    if secondary_entity and secondary_entity != entity:
        sec = sec.withColumnRenamed(secondary_entity, entity)
    sec = semi_by_values(sec, primary, entity).distinct()
    return primary.distinct().unionByName(sec, allowMissingColumns=True)


def days_of_rest(outs: DataFrame, entity: str, season: str, date: str, game: str,
                 first_value: int = 3, name: str = "days_of_rest",
                 flag_double_header: bool = False) -> DataFrame:
    """Days of rest before each outing, per (entity, season) in date order.

    gap = days since the previous outing - 1 (the first outing of a season
    gets ``first_value``); a zero gap that follows a zero gap becomes -1
    (third day running).  A second game on the same date gives -1.  Same
    date outings are ordered by ``game``.  Groups are one row per outing,
    bounded by the calendar, so a plain window is safe here.
    """
    order = [date, game]
    x = lag_bounded(outs, [entity, season], order, date, 1, "_prev_date")
    x = x.withColumn("_gap", F.when(F.col("_prev_date").isNull(), F.lit(first_value))
                               .otherwise(F.datediff(date, "_prev_date") - 1))
    x = lag_bounded(x, [entity, season], order, "_gap", 1, "_prev_gap")
    x = x.withColumn(name, F.when((F.col("_gap") == 0) & (F.col("_prev_gap") == 0),
                                  F.col("_gap") - 1).otherwise(F.col("_gap")))
    if flag_double_header:
        # -1 means both "third day running" and "second game that day";
        # this flag tells them apart without changing the value
        x = x.withColumn("double_header", F.col("_prev_date") == F.col(date))
    return x.drop("_prev_date", "_gap", "_prev_gap")


def rest_label(days: str | Column) -> Column:
    d = F.col(days) if isinstance(days, str) else days
    out = None
    for v, lab in zip(REST_VALUES, REST_LABELS):
        out = (F.when(d == v, F.lit(lab)) if out is None else out.when(d == v, F.lit(lab)))
    return out


def rest_profile(rest: DataFrame, entity: str, season: str, date: str,
                 days: str = "days_of_rest", max_rest: int = 10,
                 season_after=None) -> DataFrame:
    """Counts of the twelve rest labels per entity, their total and shares.

    Outings with more than ``max_rest`` days are dropped, then each
    season's first date; ``season_after`` keeps seasons strictly after it.
    """
    x = rest.where(F.col(days) <= max_rest)
    # one row per outing: (entity, season) groups are bounded by the calendar
    x = group_filter_not_min(x, [entity, season], date, bounded=True)
    if season_after is not None:
        x = x.where(F.col(season) > season_after)
    x = x.withColumn("_label", rest_label(days))
    wide = pivot_fixed(x, [entity], "_label", F.count(F.lit(1)), REST_LABELS, fill=0)
    total = sum((F.col(c) for c in REST_LABELS), F.lit(0))
    wide = wide.withColumn("total", total.cast("long"))
    props = {f"{c}_prop": safe_div(c, "total") for c in REST_LABELS}
    wide = wide.withColumns(props)
    return wide.withColumn("entropy", entropy_of_shares([f"{c}_prop" for c in REST_LABELS]))


def entropy_term(p: Column) -> Column:
    """p * ln(p), with 0 at p = 0."""
    return F.when(p == 0, F.lit(0.0)).otherwise(p * F.log(p))


def entropy_of_shares(share_cols: Sequence[str]) -> Column:
    """-sum p ln p over share columns of one row (NULL shares count 0)."""
    terms = [F.coalesce(entropy_term(F.col(c)), F.lit(0.0)) for c in share_cols]
    return -sum(terms[1:], terms[0])


def shannon_entropy(df: DataFrame, entity: str, label: str,
                    name: str = "entropy") -> DataFrame:
    """Long form: entropy of the label distribution of each entity
    (NULL labels ignored; a NULL entity is an entity).  One map-side-combined
    aggregate and a window over its few labels an entity, no pivot."""
    c = df.where(F.col(label).isNotNull()).groupBy(entity, label) \
          .agg(F.count(F.lit(1)).alias("_c"))
    p = c.withColumn("_p", F.col("_c") / F.sum("_c").over(Window.partitionBy(entity)))
    return p.groupBy(entity).agg((-F.sum(entropy_term(F.col("_p")))).alias(name))


def weighted_mean(x: str, w: str) -> Column:
    """``weighted.mean(x, w)``: NULL when any x is NULL (no na.rm)."""
    return F.when(F.count(x) == F.count(F.lit(1)),
                  F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(w)))


def career_weighted_metric(seasons: DataFrame, entity: str, metrics: Sequence[str],
                           weight: str, entropy: DataFrame | None = None,
                           entropy_col: str = "entropy",
                           product_of: str | None = None,
                           product_name: str = "metric_entropy") -> DataFrame:
    """Appearance-weighted career value of season metrics, the summed
    weight, and (optionally) one metric times the entity's entropy."""
    aggs = [weighted_mean(m, weight).alias(m) for m in metrics]
    out = seasons.groupBy(entity).agg(*aggs, F.sum(weight).alias(weight))
    if entropy is not None:
        out = out.join(entropy, entity, "left")
        if product_of:
            out = out.withColumn(product_name, F.col(product_of) * F.col(entropy_col))
    return out


def rest_bucket_performance(apps: DataFrame, rest: DataFrame, entity: str, game: str,
                            season: str, date: str, runs_bs: str, runs_allowed: str,
                            exp_runs: str, outs: str, days: str = "days_of_rest",
                            max_rest: int = 10, season_after=None,
                            min_total: int = 15) -> DataFrame:
    """Runs saved per 3 outs by days of rest, per entity.

    Appearances are joined to their outing's rest, restricted to
    ``days <= max_rest`` (and seasons after ``season_after``), each
    season's first date dropped, actual/expected saved runs centred on
    their table means, then summed per (days, entity).  Entities with
    ``min_total`` or fewer appearances over all buckets are dropped.
    """
    # season and date come from the outing's rest row
    x = apps.drop(season, date, days).join(rest.select(entity, game, season, date, days),
                                           [entity, game], "left")
    cond = F.col(days) <= max_rest
    if season_after is not None:
        cond = cond & (F.col(season) > season_after)
    # the joined appearances feed the first-date filter, the table means and
    # the roll-up: written once, read three times
    x = materialize(x.where(cond))
    x = group_filter_not_min(x, [entity, season], date)
    x = x.withColumns({"_rapo": F.col(runs_bs) - F.col(runs_allowed),
                       "_xrapo": F.col(runs_bs) - F.col(exp_runs)})
    m = scalar_aggs(x, {"m1": F.avg("_rapo"), "m2": F.avg("_xrapo")})
    x = x.withColumns({"_rapo": F.col("_rapo") - m["m1"], "_xrapo": F.col("_xrapo") - m["m2"]})
    g = x.groupBy(days, entity).agg(
        F.count(F.lit(1)).alias("appearances"),
        zsum(outs).alias("outs_made"),
        zsum("_rapo").alias("_sr"), zsum("_xrapo").alias("_sx"))
    g = g.withColumns({"rapo": safe_div("_sr", "outs_made") * 3,
                       "xrapo": safe_div("_sx", "outs_made") * 3})
    g = g.withColumns({"rapo_app": F.col("rapo") / F.col("appearances"),
                       "xrapo_app": F.col("xrapo") / F.col("appearances")}).drop("_sr", "_sx")
    # at most one row a rest value and entity, so the total is a window
    g = g.withColumn("_tot", F.sum("appearances").over(Window.partitionBy(entity)))
    return g.where(F.col("_tot") > min_total).drop("_tot")


def rest_bucket_slices(perf: DataFrame, days: str = "days_of_rest", ordered: bool = True) -> dict[str, DataFrame]:
    """The three published slices: back-to-back-to-back, back-to-back and
    one to three days, each with its own outs threshold, best first."""
    d, o = F.col(days), F.col("outs_made")
    out = {"b2b2b": perf.where((d < 0) & (o > 5)), "b2b": perf.where((d == 0) & (o > 20)),
           "one_to_three": perf.where(d.between(1, 3) & (o > 30))}
    best = F.col("rapo").desc_nulls_last()
    return {k: x.orderBy(best) if ordered else x for k, x in out.items()}


def ranked_slices(perf: DataFrame, entity: str, days: str = "days_of_rest") -> DataFrame:
    """The published slices in one table: ``slice``, and ``place`` by
    ``rapo`` inside it (NULL last, ties by entity and rest)."""
    parts = [x.withColumn("slice", F.lit(k)) for k, x in rest_bucket_slices(perf, days, ordered=False).items()]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.withColumns({"_null": F.col("rapo").isNull(), "_m": -F.col("rapo")})
    return row_number_in_group(x, ["slice"], ["_null", "_m", entity, days], "place").drop("_null", "_m")
