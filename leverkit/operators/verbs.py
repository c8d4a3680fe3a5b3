"""Generic dataframe verbs the analyses are built from.

Each verb picks the shape that keeps a hot key from landing in one task:
group-level values are computed with map-side-combined aggregates and
joined back, and row-order dependent steps go through
``leverkit.plans.ordered``.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import in_set
from ..plans.ordered import exact_quantiles
from ..plans.selection import broadcast_if_small, digest_cuts



def scalar_aggs(df: DataFrame, aggs: dict[str, Column]) -> dict[str, Column]:
    """Table-wide aggregates as one scalar subquery.

    The subquery is a partial aggregate run once before the main plan; its
    value is used as a constant, so there is no join at all, and a branch
    that does not use it does not compute it.  The returned Columns are
    fields of the same struct subquery (Spark reuses it).
    """
    return scalar_aggs_of(df.select(*[a.alias(n) for n, a in aggs.items()]))


def scalar_aggs_of(row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row frame as one scalar subquery."""
    names = row.columns
    sub = row.select(F.struct(*names).alias("_s")).scalar()
    return {n: sub[n] for n in names}


def top_ties(df: DataFrame, by: Sequence[str], order_col: str | Sequence[str],
             dedup: bool = False) -> DataFrame:
    """Rows holding the group maximum of ``order_col``; ties are all kept.

    Written as ``rank() = 1`` so the optimizer inserts a partial
    window-group-limit before the exchange: each map task forwards only its
    local top rows per group, so a hot group shrinks before the shuffle.
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    w = Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in order])
    out = df.withColumn("_rk", F.rank().over(w)).where("_rk = 1").drop("_rk")
    return out.distinct() if dedup else out


def join_keys_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                        how: str = "left") -> DataFrame:
    """Equi-join where NULL keys match each other (a NULL group is still a
    group, as in grouped mutate).  Planned as a normal hash/sort-merge join;
    the right side's key columns are dropped."""
    r = right.withColumnsRenamed({k: f"_rk_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])  # absent after a semi-join


def group_filter_not_min(df: DataFrame, by: Sequence[str], col: str,
                         bounded: bool = False) -> DataFrame:
    """Drop the rows that hold the group minimum of ``col``
    (``group_by(g) %>% filter(x != min(x))``).

    ``bounded=True`` (groups small by construction, e.g. one row per
    outing of a season) uses a window min, which reuses an existing
    partitioning on ``by``; otherwise a partial aggregate is joined back.
    """
    if bounded:
        w = Window.partitionBy(*by)
        return (df.withColumn("_gmin", F.min(col).over(w))
                  .where(F.col(col) != F.col("_gmin")).drop("_gmin"))
    m = df.groupBy(*by).agg(F.min(col).alias("_gmin"))
    return (join_keys_null_safe(df, m, list(by), "inner")
              .where(F.col(col) != F.col("_gmin")).drop("_gmin"))


def having_group_total(df: DataFrame, by: Sequence[str], col: str,
                       greater_than: float) -> DataFrame:
    """Keep groups whose total of ``col`` exceeds a threshold
    (``group_by(g) %>% filter(sum(n) > k)``); a NULL key is a group."""
    keep = (df.groupBy(*by).agg(F.sum(col).alias("_tot"))
              .where(F.col("_tot") > greater_than).select(*by))
    return join_keys_null_safe(df, keep, list(by), "left_semi")


def center(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Subtract the table-wide mean (NULLs skipped) from each column.

    The mean is a one-row aggregate, broadcast to every task; there is no
    un-partitioned window over the table.
    """
    m = scalar_aggs(df, {c: F.avg(c) for c in cols})
    return df.withColumns({f"{c}{suffix}": F.col(c) - m[c] for c in cols})


def scale_by_mean_abs(df: DataFrame, col: str, name: str) -> DataFrame:
    """``abs(x) / mean(abs(x))`` over the whole table."""
    m = scalar_aggs(df, {"mabs": F.avg(F.abs(F.col(col)))})
    return df.withColumn(name, F.abs(F.col(col)) / m["mabs"])


def impute_mean(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Replace NULLs by the column mean of the same frame (one pass)."""
    m = scalar_aggs(df, {c: F.avg(c) for c in cols})
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.col(c), m[c]) for c in cols})


def one_hot(df: DataFrame, col: str, levels: Sequence[str], na_level: bool = False,
            prefix: str | None = None, drop_source: bool = True) -> DataFrame:
    """One 0/1 column per fixed level (``<col>_<level>``); with ``na_level``
    an extra ``<col>_NA`` marks a missing value.  A missing value is 0 in
    every level column."""
    p = prefix if prefix is not None else f"{col}_"
    c = F.col(col)
    new = {f"{p}{lv}": F.coalesce((c == F.lit(lv)).cast("int"), F.lit(0)) for lv in levels}
    if na_level:
        new[f"{p}NA"] = c.isNull().cast("int")
    out = df.withColumns(new)
    return out.drop(col) if drop_source else out


def modal_level(df: DataFrame, col: str) -> DataFrame:
    """One-row frame with the most frequent non-NULL level (ties: the
    alphabetically first)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).count()
              .orderBy(F.col("count").desc(), F.col(col).asc()).limit(1)
              .select(F.col(col).alias("_modal")))


def one_hot_drop_modal(df: DataFrame, col: str, levels: Sequence[str],
                       long_form: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """One-hot with the most frequent level left out.

    The modal level is data dependent, so the wide form is built after one
    tiny aggregate; ``long_form`` returns (key..., level, indicator) rows
    for the kept levels instead, which needs no driver round trip.
    """
    if long_form:
        modal = modal_level(df, col).scalar()
        every = F.array(*[F.lit(x) for x in levels])
        return (df.select(*key, col, F.explode(every).alias("level"))
                  .where(~F.col("level").eqNullSafe(modal))
                  .select(*key, "level",
                          F.coalesce((F.col(col) == F.col("level")).cast("int"),
                                     F.lit(0)).alias("indicator")))
    row = modal_level(df, col).first()
    drop = row["_modal"] if row else None
    return one_hot(df, col, [x for x in levels if x != drop])


def pivot_fixed(df: DataFrame, ids: Sequence[str], names_from: str, values: Column,
                levels: Sequence[str], fill=0, prefix: str = "") -> DataFrame:
    """``pivot_wider`` with a fixed level list: one aggregation, stable
    schema, missing cells filled.  Rows whose label is NULL or not in the
    list still create their id row."""
    agg = (df.groupBy(*ids).pivot(names_from, list(levels)).agg(values))
    ren = {lv: f"{prefix}{lv}" for lv in levels}
    agg = agg.withColumnsRenamed(ren) if prefix else agg
    return agg.na.fill(fill, subset=[f"{prefix}{lv}" for lv in levels])


def param_grid(spark, **axes: Iterable) -> DataFrame:
    """Cartesian grid of tuning values with a 1-based ``row_num``."""
    names = list(axes)
    rows = [tuple(v) + (i + 1,) for i, v in enumerate(itertools.product(*axes.values()))]
    schema = ", ".join(f"{n} double" for n in names) + ", row_num int"
    rows = [tuple(float(x) for x in r[:-1]) + (r[-1],) for r in rows]
    return spark.createDataFrame(rows, schema)


def stratified_split(df: DataFrame, key: Sequence[str], strata: str, prop: float,
                     seed: int = 101, flag: str = "is_train",
                     numeric_bins: int | None = None) -> DataFrame:
    """Deterministic stratified split with exact per-stratum proportions.

    Rows are ordered inside their stratum by ``md5(key || ':' || seed)``; the
    first ``floor(n * prop)`` go to training (rows that share a key go to the
    same side).  Numeric strata can be binned into ``numeric_bins`` quantile
    bins first.  The order is never made: the digest that the last training
    row has is found by counting (``selection.digest_cuts``), and the rows are
    compared with it where they are; no row is moved.  A NULL stratum is a
    stratum.
    """
    s = F.col(strata)
    if numeric_bins:
        probs = {f"_b{i}": i / numeric_bins for i in range(1, numeric_bins)}
        num = df.withColumn("_sv", F.col(strata).cast("double"))
        qs = exact_quantiles(num, [], "_sv", probs).select(
            F.array(*[F.col(k) for k in probs]).alias("_qb")).scalar()
        df = df.withColumn("_qb", qs).withColumn(
            "_stratum", F.size(F.filter("_qb", lambda b: b < F.col(strata)))).drop("_qb")
        s = F.col("_stratum")
    else:
        df = df.withColumn("_stratum", s)
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    df = df.withColumn("_h", h)
    cuts = broadcast_if_small(digest_cuts(df, ["_stratum"], "_h", prop))
    out = join_keys_null_safe(df, cuts, ["_stratum"], "left").withColumn(flag, (F.col("_h") <= F.col("_cut")).cast("int"))
    return out.drop("_stratum", "_h", "_n", "_cut")


def describe_quantiles(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """min, quartiles (type 7), mean, max and NULL count of one column."""
    c = F.col(col)
    simple = df.agg(F.min(c).alias(f"{prefix}min"), F.avg(c).alias(f"{prefix}mean"),
                    F.max(c).alias(f"{prefix}max"),
                    F.count_if(c.isNull()).alias(f"{prefix}n_null"))
    names = [f"{prefix}q1", f"{prefix}median", f"{prefix}q3"]
    qs = exact_quantiles(df, [], col, dict(zip(names, [0.25, 0.5, 0.75])))
    q = qs.select(F.struct(*names).alias("_q")).scalar()
    return simple.select(f"{prefix}min", q[names[0]].alias(names[0]),
                         q[names[1]].alias(names[1]), f"{prefix}mean",
                         q[names[2]].alias(names[2]), f"{prefix}max", f"{prefix}n_null")


def semi_by_values(df: DataFrame, other: DataFrame, key: str,
                   other_key: str | None = None) -> DataFrame:
    """``filter(k %in% other$k)`` as a left-semi join (NULL never matches)."""
    ok = other_key or key
    keys = other.select(F.col(ok).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.join(keys, key, "left_semi")


__all__ = [n for n in dir() if not n.startswith("_")] + ["in_set"]
