"""Ordered-window primitives that survive hot groups.

A window ``partitionBy(g).orderBy(o)`` sends every row of one ``g`` to one
task.  When a group can hold a large share of the table that task never
finishes.  So the primitives first count rows per group (a map-side-combined
aggregate).  While no group is above ``max_group_rows`` the plain window is
used (one exchange).  Otherwise the whole table is range-partitioned on the
group and all order columns and written to the shared folder: a hot group is
then many ranges of about ``max_group_rows`` rows, whatever its order columns
look like (one constant column, long common string prefixes, NULL groups and
NULL order values included), as long as the order is total.  The window runs
inside a range; the values that cross from one range to the next come from a
table with one row per range.

Results are exact: ranges only decide *where* rows are processed.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

MAX_GROUP_ROWS_CONF = "leverkit.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000


def max_group_rows(df: DataFrame, override: int | None = None) -> int:
    if override is not None:
        return int(override)
    v = df.sparkSession.conf.get(MAX_GROUP_ROWS_CONF, None)
    return int(v) if v else DEFAULT_MAX_GROUP_ROWS


def has_heavy_groups(df: DataFrame, by: Sequence[str], max_rows: int | None = None) -> bool:
    """Whether any group of ``by`` holds more than the row limit.  No group
    of a finer key (``by`` plus more columns) can be heavy when this is
    False, so one probe on the coarse key settles the finer ones."""
    limit = max_group_rows(df, max_rows)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).limit(1).count() > 0


def _neighbour(edges: DataFrame, step: int) -> DataFrame:
    """Each range's row with, as ``_near``, that of the range ``step`` places
    on.  One row a range, so as many as there are tasks: they are put in order
    as one array, which needs no window over the table."""
    row = F.struct("_p", *[c for c in edges.columns if c != "_p"])
    one = edges.agg(F.sort_array(F.collect_list(row)).alias("a"))
    # a place outside the array gives NULL, and a negative one must not count from its end
    near = lambda i: F.when(i + step >= 0, F.get("a", i + step))
    pairs = F.transform("a", lambda x, i: F.struct(x.alias("x"), near(i).alias("n")))
    return one.select(F.explode(pairs).alias("e")).select("e.x.*", F.col("e.n").alias("_near"))


class _Ranges:
    """A table range-partitioned on (by, order) and written.

    ``rows`` carries ``_p``, the number of a row's range; ``edges`` has one
    row per range, in order: its first and last group, its rows of the last
    group and, as ``_next``/``_prev``, the neighbouring ranges' values.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int):
        spark = df.sparkSession
        shared_dir(spark)
        self.by, self.order = list(by), list(order)
        keys = [F.col(c).asc_nulls_first() for c in [*self.by, *self.order]]
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / limit))
        # always written: the ranges come from a sample and must not be drawn twice
        self.rows = (df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id())
                       .checkpoint(eager=True))
        self.window = Window.partitionBy("_p", *self.by).orderBy(*keys[len(self.by):])

    def _group(self, cols=None) -> Column:
        """The group as one comparable value (a struct is never NULL itself)."""
        return F.struct(F.lit(0).alias("_"), *[F.col(c) for c in (cols or self.by)])

    def place(self) -> Column:
        return F.struct(F.lit(0).alias("_"), *[F.col(c) for c in [*self.by, *self.order]])

    def is_last(self) -> Column:
        """Whether a row is the last of its group in its range."""
        return F.lead(F.lit(1)).over(self.window).isNull()

    def next_first(self, cols: Sequence[str]) -> DataFrame:
        """Per range: ``_g``, the group that the next range begins with, and
        ``_nf``, the values of its first row."""
        first = self.rows.groupBy("_p").agg(
            F.min_by(F.struct(self._group().alias("g"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in cols]).alias("v")),
                     self.place()).alias("f"))
        n = _neighbour(first, 1)
        return n.select("_p", F.col("_near.f.g").alias("_g"), F.col("_near.f.v").alias("_nf"))

    def before(self, total: Column) -> DataFrame:
        """Per range: ``_g``, its first group, and ``_before``, what ``total``
        adds up to over that group's rows in earlier ranges."""
        size = self.rows.groupBy("_p", *self.by).agg(total.alias("t")).withColumn("g", self._group())
        ends = size.groupBy("_p").agg(F.min("g").alias("lo"), F.max(F.struct("g", "t")).alias("hi"))
        run = F.sum("hi.t").over(Window.partitionBy("hi.g").orderBy("_p"))
        n = _neighbour(ends.withColumn("run", run), -1)
        return n.select("_p", F.col("lo").alias("_g"), F.when(
            F.col("_near.hi.g").eqNullSafe(F.col("lo")), F.col("_near.run")).alias("_before"))

    def attach(self, df: DataFrame, edges: DataFrame) -> DataFrame:
        # one row a range, as many as there are tasks
        return df.join(F.broadcast(edges), "_p", "left")

    def same_group(self) -> Column:
        return self._group().eqNullSafe(F.col("_g"))


def _heavy(df: DataFrame, by: Sequence[str], limit: int, assume_light: bool) -> bool:
    # the whole table in one order is always ranged, whatever its size
    return not assume_light and (not by or has_heavy_groups(df, by, limit))


def lead_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str],
                  cols: Sequence[str], prefix: str = "next_",
                  max_rows: int | None = None,
                  last_flag: str | None = None,
                  group_aggs: dict[str, Column] | None = None,
                  assume_light: bool = False) -> DataFrame:
    """``lead(c, 1) over (partition by by order by order)`` for each c.

    ``by`` may be empty (a lead over the whole table).  ``order`` must be a
    total order inside each group (add a tiebreak column).  When
    ``last_flag`` is given, a boolean column marks each group's last row.
    ``group_aggs`` (name -> aggregate Column) adds whole-group aggregates:
    computed in the same window when no group is heavy (no extra
    exchange), else as a partial aggregate joined back.
    ``assume_light`` skips the probe when the caller has already shown no
    group can be heavy (see ``has_heavy_groups``).
    """
    by, limit = list(by), max_group_rows(df, max_rows)
    if not _heavy(df, by, limit, assume_light):
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in cols})
        if last_flag:
            out = out.withColumn(last_flag, F.lead(F.lit(1)).over(w).isNull())
        if group_aggs:
            wg = Window.partitionBy(*by)
            out = out.withColumns({n: a.over(wg) for n, a in group_aggs.items()})
        return out
    r = _Ranges(df, by, order, limit)
    x = r.rows.withColumns({f"_w_{i}": F.lead(c).over(r.window) for i, c in enumerate(cols)} | {"_end": r.is_last()})
    x = r.attach(x, r.next_first(cols)).withColumn("_cross", F.col("_end") & r.same_group())
    out = x.withColumns({f"{prefix}{c}": F.when(F.col("_cross"), F.col("_nf")[c]).otherwise(F.col(f"_w_{i}"))
                         for i, c in enumerate(cols)})
    if last_flag:
        out = out.withColumn(last_flag, F.col("_end") & ~F.col("_cross"))
    out = out.drop(*[f"_w_{i}" for i in range(len(cols))], "_end", "_cross", "_nf", "_g", "_p")
    if group_aggs:
        g = df.groupBy(*by).agg(*[a.alias(n) for n, a in group_aggs.items()])
        # without a key the aggregate is one row
        out = _join_null_safe(out, g, by) if by else out.withColumns(
            {n: g.select(n).scalar() for n in group_aggs})
    return out


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = right.withColumnsRenamed({k: f"__rk_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__rk_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"__rk_{k}" for k in keys])


def running_sum_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column,
                         name: str, max_rows: int | None = None) -> DataFrame:
    """``sum(value) over (partition by by order by order rows up to here)``
    as a long, split-safe."""
    by, limit = list(by), max_group_rows(df, max_rows)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if not _heavy(df, by, limit, False):
        w = up_to(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn(name, F.sum(value.cast("long")).over(w))
    r = _Ranges(df.withColumn("_v", value.cast("long")), by, order, limit)
    x = r.rows.withColumn("_s", F.sum("_v").over(up_to(r.window)))
    x = r.attach(x, r.before(F.sum("_v")))
    off = F.when(r.same_group(), F.coalesce("_before", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return x.withColumn(name, F.col("_s") + off).drop("_s", "_v", "_g", "_before", "_p")


def row_number_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str],
                        name: str = "rn", max_rows: int | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)`` as a long, split-safe."""
    return running_sum_in_group(df, by, order, F.lit(1), name, max_rows)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    probs: dict[str, float], max_rows: int | None = None) -> DataFrame:
    """Type-7 (linear interpolation) quantiles of ``value`` per group.

    NULL values are ignored; a group of only NULLs gives NULL.  Light
    groups use the exact ``percentile`` aggregate.  If a group is above the
    row limit, equal values are counted first (so a repeated value is one
    row), a split-safe running sum of the counts gives the ranks that each
    value holds, and the wanted ranks are picked; no group is collected or
    sorted in one place.
    """
    by, limit = list(by), max_group_rows(df, max_rows)
    base = df.select(*by, value)
    if not has_heavy_groups(base, by, limit):
        # an aggregate, not an order
        return base.groupBy(*by).agg(*[F.percentile(F.col(value), p).alias(k) for k, p in probs.items()])
    all_null = base.groupBy(*by).agg(F.count(value).alias("_n"))
    counts = base.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    runs = running_sum_in_group(counts, by, [value], F.col("_c"), "_to", limit)
    runs = _join_null_safe(runs, all_null, by) if by else runs.withColumn("_n", all_null.scalar())
    aggs = []
    for i, p in enumerate(probs.values()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in (("l", F.floor(h)), ("h", F.ceil(h))):
            # ranks from 0: the value holds _to - _c .. _to - 1
            aggs.append(F.max(F.when((rank >= F.col("_to") - F.col("_c")) & (rank < F.col("_to")), F.col(value))).alias(f"_{side}{i}"))
        aggs += [F.max(F.ceil(h) - h).alias(f"_a{i}"), F.max(h - F.floor(h)).alias(f"_b{i}")]
    got = runs.groupBy(*by).agg(*aggs).select(*by, *[
        F.when(F.col(f"_b{i}") == 0, F.col(f"_l{i}").cast("double"))
        .otherwise(F.col(f"_a{i}") * F.col(f"_l{i}") + F.col(f"_b{i}") * F.col(f"_h{i}")).alias(k) for i, k in enumerate(probs)])
    return _join_null_safe(all_null.drop("_n"), got, by) if by else got


def lag_bounded(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str,
                offset: int = 1, name: str | None = None) -> DataFrame:
    """Plain ``lag`` for groups whose size is bounded by construction
    (e.g. one row per entity-day within a season, or per entity-year)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name or f"lag{offset}_{col}", F.lag(col, offset).over(w))
