"""Distributed selection: the value below which a wanted number of rows lie,
without sorting or moving the rows.

The keys are hexadecimal digests.  Rows are counted by the first digits of
their digest (a map-side combined aggregate of at most 16^digits rows a group
and task), a running sum over those counts finds the digits that the wanted
rank falls on, and only the rows that begin so are looked at again.  Each pass
keeps about one row in 65,536, so a table of 10^13 rows needs three.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DIGITS = 4
#: digests of one group that are told apart in one place once so few are left
LEFT = 50_000


#: a table of group values is broadcast up to this many rows (counted)
BROADCAST_ROWS = 200_000


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """Mark a written frame of narrow rows for broadcast if its counted rows
    are few; beyond that the join is left to a shuffle."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], more=()) -> DataFrame:
    """Inner join on ``by`` (NULL is a group) and equal columns ``more``."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & left[k].eqNullSafe(r[f"__{k}"])
    for a, b in more:
        cond = cond & (a == r[b])
    return left.join(r, cond).drop(*[f"__{k}" for k in by])


def digest_cuts(df: DataFrame, by: Sequence[str], digest: str, share: float, left: int = LEFT,
                digits: int = DIGITS, length: int = 32) -> DataFrame:
    """Per group of ``by``: ``_n``, its rows, and ``_cut``, such that as many
    rows as possible, but no more than floor(_n * share), have ``digest <=
    _cut``.  Rows of one digest fall on the same side, so the number is exact
    where digests are distinct.
    """
    by = list(by)
    rows, open_, done, taken = df.select(*by, F.col(digest).alias("_d")), None, None, 0
    while True:
        taken = min(length, taken + digits)
        counts = rows.groupBy(*by, F.substring("_d", 1, taken).alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
        # over counts of heads, not over rows: at most 16^digits or ``left`` a group
        every = Window.partitionBy(*by)
        if open_ is None:
            run = counts.withColumn("_n", F.sum("_c").over(every)).withColumns({"_want": F.floor(F.col("_n") * F.lit(share)), "_cut": F.lit("")})
        else:
            run = _beside(counts, open_, by)
        run = run.withColumn("_to", F.sum("_c").over(every.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)))
        fits = F.col("_to") <= F.col("_want")
        fit = run.groupBy(*by).agg(F.max("_n").alias("_n"), F.max("_want").alias("_want"), F.max("_cut").alias("_old"),
                                   F.max(F.when(fits, F.col("_h"))).alias("_fit"), F.max(F.when(fits, F.col("_to"))).alias("_have"),
                                   F.min(F.when(~fits, F.struct("_h", "_c"))).alias("_over"))
        # what begins with a head that fits comes before the next head: '~' sorts after every digit
        fit = materialize(fit.withColumn("_cut", F.coalesce(F.concat("_fit", F.lit("~")), "_old")))
        last = taken == length
        settled = (fit if last else fit.where(F.col("_over").isNull())).select(*by, "_n", "_cut")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        more = fit.where(F.col("_over").isNotNull())
        most = more.agg(F.max("_over._c")).first()[0]
        if most is None:
            return done
        # the head that the wanted rank falls into: one a group; written, as each pass is a small part of the last
        rows = materialize(_beside(rows, broadcast_if_small(more.select(*by, F.col("_over._h").alias("_in"))), by, [(F.substring("_d", 1, taken), "_in")]).drop("_in"))
        open_ = more.select(*by, "_n", (F.col("_want") - F.coalesce("_have", F.lit(0))).alias("_want"), "_cut")
        if most <= left:
            taken = length  # few enough to be told apart by the whole digest
