"""Operator 2: benchmark decontamination by a prefix-filtered set join.

A benchmark window (13 consecutive words, or the whole of a shorter item) is a
set of word shingles.  For exact containment the prefix of a window in a global
rarity order is its single rarest shingle, so only that one has to be joined:

1. count every benchmark shingle over all documents (rarity);
2. each distinct window keeps its rarest shingle and the offset at which it
   stands; a window with a shingle that no document has is out;
3. documents emit the shingles that may be prefixes; the join on the shingle
   applies the positional bound (the window must begin inside the text) and the
   length bound (it must end inside it);
4. the words around the shingle are compared with the window's words.

Documents meet the prefixes through a slot table of fixed size (a one-hash
Bloom filter), so what is broadcast does not grow with the benchmark; false
positives fall out in the join.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import (ALNUM_WORDS, saved, scan_words, shingle_hashes, small_or_plain, text_batches,
                                 table, text_key)

WINDOW = 13
SHINGLE = 3
#: slots of the filter that is broadcast, one byte each
SLOTS = 1 << 21
#: bytes assumed for one prefix row (hash, offset, window text) when its broadcast is checked
PREFIX_ROW_BYTES = 512


def _cut_windows(window: int, shingle: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c in scan_words(b.column("text"), ALNUM_WORDS):
                for i in range(c.hi - c.lo):
                    a, z = int(c.first[i]), int(c.first[i + 1])
                    if a == z:
                        continue
                    n = min(window, z - a)
                    k = min(shingle, n)
                    sh = shingle_hashes(c.hash[a:z], k).view(np.int64)
                    item = b.column("item_id")[c.lo + i].as_py()
                    for s in range(z - a - n + 1):
                        rows.append((item, c.text(a + s, a + s + n), n, k, sh[s:s + n - k + 1].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate(
                    (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))],
                ["item_id", "win", "n", "k", "shingles"])
    return cut


def windows_of(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every window of every item: item_id, win (its words joined by a space),
    n (words), k (words a shingle), shingles (their hashes in order)."""
    b = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    return b.mapInArrow(_cut_windows(window, shingle),
                        "item_id long, win string, n int, k int, shingles array<long>")


def _slots(hashes: DataFrame, col: str, slots: int) -> np.ndarray:
    """Slot table of a column of hashes.  At most ``slots`` numbers reach the driver."""
    out = np.zeros(slots, np.uint8)
    got = hashes.select(F.pmod(F.col(col), F.lit(slots)).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()
    out[got] = 1
    return out


def _count(sizes: list[int], slots_b):
    def count(batches):
        for b in batches:
            slots, found = slots_b.value, []
            for c in scan_words(b.column("text"), ALNUM_WORDS):
                rows = np.repeat(np.arange(c.hi - c.lo), np.diff(c.first))
                for k in sizes:
                    h = shingle_hashes(c.hash, k)
                    ok = slots[(h.view(np.int64) % len(slots))] > 0
                    ok &= rows[:len(h)] == rows[k - 1:]
                    found.append(h[ok])
            u, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    return count


_CAND = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("ctx", pa.string())])


def _probe(sizes: list[int], window: int, slots_b):
    """One row a document: its word count and the shingles that may be prefixes,
    each with its position and the words around it, the first at ``at``."""
    def probe(batches):
        for b in batches:
            slots = slots_b.value
            n_words, cands = [], []
            for c in scan_words(b.column("text"), ALNUM_WORDS):
                rows = np.repeat(np.arange(c.hi - c.lo), np.diff(c.first))
                mine: list[list] = [[] for _ in range(c.hi - c.lo)]
                for k in sizes:
                    h = shingle_hashes(c.hash, k)
                    ok = slots[(h.view(np.int64) % len(slots))] > 0
                    ok &= rows[:len(h)] == rows[k - 1:]
                    for j in np.flatnonzero(ok):
                        i = int(rows[j])
                        lo, hi = int(c.first[i]), int(c.first[i + 1])
                        a = max(lo, int(j) - window + k)
                        mine[i].append({"h": int(h[j].view(np.int64)), "pos": int(j) - lo, "at": a - lo,
                                        "ctx": c.text(a, min(hi, int(j) + window))})
                n_words.extend(np.diff(c.first).tolist())
                cands.extend(mine)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in ("doc_id", "key")), pa.array(n_words, pa.int64()),
                 pa.array(cands, pa.list_(_CAND))], ["doc_id", "key", "n_words", "cands"])
    return probe


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  least_share: int = 20) -> DataFrame:
    """One row a document: doc_id, key (content key of its text), n_words,
    n_hit (words inside an occurrence of a benchmark window), items (ids of the
    items with such windows, sorted as strings), contaminated
    (n_hit > 0 and least_share * n_hit >= n_words).

    Defined cases: a null or empty text and a text without words have no words
    and are clean; null and empty items have no windows; a null item id counts
    as the string ``null``; repeated rows each get a row; documents of any
    length are searched whole; an empty benchmark hits nothing; other columns
    of the inputs are not looked at.
    """
    spark = docs.sparkSession
    text_batches(spark)
    wins = saved(windows_of(benchmark, window, shingle), "windows")
    texts = wins.dropDuplicates(["win"]).select("win", "n", "k", "shingles")
    sizes = sorted(r[0] for r in wins.select("k").distinct().collect())  # at most `shingle` numbers
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    # 1. rarity over all documents
    every = texts.select(F.explode("shingles").alias("h")).distinct()
    slots = spark.sparkContext.broadcast(_slots(every, "h", SLOTS))
    counts = (d.select("text").mapInArrow(_count(sizes, slots), "h long, n long")
              .groupBy("h").agg(F.sum("n").alias("df")))
    # 2. the rarest shingle of each window
    each = texts.select("win", "n", F.posexplode("shingles").alias("offset", "h")).join(counts, "h", "left")
    prefixes = (each.groupBy("win", "n")
                .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("p"))
                .where("p.df > 0").select(F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), "win", "n"))
    prefixes = saved(prefixes, "prefixes")
    # 3. documents probe the prefixes
    probe_slots = spark.sparkContext.broadcast(_slots(prefixes, "h", SLOTS))
    scan = saved(d.mapInArrow(_probe(sizes, window, probe_slots),
                              "doc_id long, key binary, n_words long, "
                              "cands array<struct<h:long,pos:int,at:int,ctx:string>>"), "probes")
    cand = scan.select("key", "n_words", F.inline("cands"))
    first = F.col("pos") - F.col("offset")
    hits = (cand.join(small_or_plain(prefixes, PREFIX_ROW_BYTES), "h")
            .where((first >= 0) & (first + F.col("n") <= F.col("n_words")))
            # 4. exact containment
            .where(F.array_join(F.slice(F.split("ctx", " "), first - F.col("at") + 1, F.col("n")), " ") == F.col("win"))
            .select("key", first.alias("first"), "n", "win").distinct())
    hits = saved(hits, "hits")
    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("n")).alias("last")))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("words")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["last"]).alias("upto"),
                              (a["words"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["upto"], s["first"]))).alias("words")),
        lambda a: a["words"])
    items = (hits.select("key", "win").distinct()
             .join(wins.select("win", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")).distinct(), "win")
             .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    # written, so that the join below is free to split the key of a text with very many copies
    found = saved(spans.select("key", covered.alias("n_hit")).join(items, "key"), "found")
    out = scan.select("doc_id", "key", "n_words").join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "key", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, all their columns, whose text is not contaminated."""
    bad = contamination(docs, benchmark, **how).where("contaminated").select(F.col("key").alias("__key")).distinct()
    bad = small_or_plain(saved(bad, "contaminated"), 64)
    return docs.withColumn("__k", text_key()).join(bad, F.col("__k") == F.col("__key"), "left_anti").drop("__k")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH
dw AS (SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
         FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT r, s, win.n, item_id FROM dwin JOIN win ON dwin.t = win.t AND dwin.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
