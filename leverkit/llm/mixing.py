"""Operator 7: mix sources to target weights.

Every document gets a hash-random key; the sizes are range-sorted by source and
key; a distributed running sum of sizes cuts each source at its exact budget,
after as many whole epochs as the budget holds.  The documents themselves stay
where they are and are compared with their source's cut.  DataFrame functions
only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import prefix_sum, saved, small_or_plain, table

WORD = r"[^\x20\x09-\x0D]+"
#: bytes assumed for one source row when its broadcast is checked
SOURCE_ROW_BYTES = 512


def word_count(text="text"):
    """Number of whitespace-separated words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source with its weight, total size and target.

    ``sizes`` has ``source`` and ``size``.  Sources are ordered by code point,
    null last, and take ``weights`` in turn.  The sum of all sizes is shared by
    weight; a target stops at ``cap`` times its source's size and what is left
    is shared again.  The fixed point of that is found in one pass: ordered by
    cap/weight, a source is capped exactly if an even share of what the capped
    sources before it leave would reach its cap.
    """
    s = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), "sources")
    by_name = F.col("source").asc_nulls_last()
    s = prefix_sum(s, [by_name], {"one": "rank", "source_size": "start"}, name="rank")
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    s = saved(s.select("source", "source_size", "start", w.alias("weight"), (F.col("source_size") * cap).alias("cap")), "weights")
    total, all_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    ratio = F.col("cap") / F.col("weight")
    s = prefix_sum(s, [ratio.asc(), by_name], {"cap": "capped_before", "weight": "weight_before"}, name="caps")
    share = (F.lit(total) - F.col("capped_before")) / (F.lit(all_weight) - F.col("weight_before"))
    s = saved(s.withColumn("share", share).withColumn("is_capped", F.col("cap") <= F.col("weight") * F.col("share")), "shares")
    level = s.where(~F.col("is_capped")).agg(F.min_by("share", F.struct("capped_before", "weight_before"))).first()[0]
    return s.select(
        "source", "source_size", "start",
        F.when(F.col("is_capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", cap: int = 3,
                weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target`` and ``taken`` words.

    A document is taken whole once for every whole epoch of its source's
    budget (the rounded target); the rest of the budget goes to the source's
    documents in hash order, cutting the last one.  The sum of ``taken`` over
    a source is exactly its budget.

    Defined cases: null or empty text has size 0 and takes 0; a null source is
    a source of its own, last in order; a null id hashes as ``null``; repeated
    rows are documents of their own (rows alike in id and size may swap their
    cut); an empty table gives no rows; further columns are kept, but input
    columns named as the four outputs are replaced.
    """
    d = docs.drop("source_size", "target", "taken").withColumn("size", word_count())
    at = F.struct(_key(seed).alias("key"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))
    sized = mix_sized(saved(d.select("doc_id", "source", "size"), "sizes"), seed, cap, weights)
    epochs = F.coalesce(F.floor(_budget() / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    rows = saved(sized.select("source", "source_size", "target", at.alias("at"), epochs.alias("epochs"),
                              (F.col("taken") - epochs * F.col("size")).alias("part")), "sized")
    # a source's rows before its cut go whole, those after it not at all
    last = F.max(F.when(F.col("part") > 0, F.struct("at", "part")))
    cuts = saved(rows.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "epochs")], last.alias("__cut")), "cuts")
    cuts = small_or_plain(cuts.withColumnsRenamed({"source": "__source", "epochs": "__epochs"}), SOURCE_ROW_BYTES)
    here = F.col("source").eqNullSafe(F.col("__source"))
    alike = rows.join(cuts.select("__source", "__cut"), here & (F.col("at") == F.col("__cut.at"))).groupBy("source").count()
    if alike.where("count > 1").take(1):  # rows alike in id and size share a cut among them: only their order tells it
        return mix_sized(d, seed, cap, weights)
    part = F.when(at < F.col("__cut.at"), F.col("size")).when(at == F.col("__cut.at"), F.col("__cut.part")).otherwise(F.lit(0))
    d = d.join(cuts, here).withColumn("taken", (F.col("__epochs") * F.col("size") + part).cast("long"))
    return d.drop("__source", "__epochs", "__cut")


def _key(seed: str):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _budget():
    return F.floor(F.col("target") + 0.5)


def mix_sized(d: DataFrame, seed: str = "mix", cap: int = 3,
              weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``mix_sources`` for documents that have their ``size`` already."""
    d = d.withColumn("__key", _key(seed))
    order = [F.col("source").asc_nulls_last(), F.col("__key").asc(), F.col("doc_id").asc(), F.col("size").asc()]
    d = prefix_sum(d, order, {"size": "__run"}, name="mix")
    s = saved(source_targets(d.select("source", "size"), cap, weights), "targets")
    s = small_or_plain(s.withColumnsRenamed({"source": "__source", "start": "__start"}), SOURCE_ROW_BYTES)
    d = d.join(s, F.col("source").eqNullSafe(F.col("__source")))
    budget = _budget()
    epochs = F.coalesce(F.floor(budget / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    left = budget - epochs * F.col("source_size") - (F.col("__run") - F.col("__start"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return d.withColumn("taken", taken.cast("long")).drop("__key", "__run", "__source", "__start")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; only sizes, not texts, are sorted and moved."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix_sized(d).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
lv AS (  -- the level at which the capped shares add up to the whole
  SELECT max(l) AS level FROM (
    SELECT a.ratio, ((SELECT sum(source_size) FROM r) - coalesce((SELECT sum(cap) FROM r b WHERE b.ratio < a.ratio), 0))::DOUBLE
                  / (SELECT sum(weight) FROM r b WHERE b.ratio >= a.ratio) AS l
    FROM r a) WHERE l <= ratio),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target
      FROM r, lv),
x AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
