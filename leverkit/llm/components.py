"""Connected components of a link table, by alternating large-star and
small-star steps.  Nodes and labels are longs; the result labels each node with
the smallest node of its component.  Only aggregates and joins are used, so a
node with very many links is never gathered in one place."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


LINKS_A_FILE = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """(node, label) for every node that has a link to another node."""
    e = saved(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links", parts)
    parts = 1 + e.count() // LINKS_A_FILE
    mark = None
    while True:
        e = saved(_small_star(_large_star(e)), "star", parts)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())
