"""Operator 6: language ID with bit-sliced Bloom filters.

Byte 4-grams of the lower-cased letters are counted per language over all
training documents.  A gram belongs to the languages in which it is about as
frequent as where it is most frequent.  The filter has one row of language bits
per slot; a gram's answer is the AND of its rows, all languages at once.  For a
text the bits are added up per language, each sum is corrected for the false
positives that the filter's fill makes likely, and the largest decides.

The filter is a fixed number of slots times one bit a language, so what is
broadcast grows with neither the corpus nor the number of grams; more grams
mean more false positives, which the correction takes out on average.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leverkit.llm.common import mix, row_chunks, saved, table, text_batches, text_buffers

SLOTS = 1 << 20
HASHES = 2
#: a gram belongs to a language if its frequency there is at least this share of its largest one
SHARE = 0.25
GRAM = 4
#: bytes of text at a time: the arrays of a chunk take about a hundred times as much
_CHUNK = 1 << 18


def _letters() -> np.ndarray:
    """Lower-cases A-Z and turns every other ASCII byte into a space."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_LETTERS = _letters()
_SPACES = np.uint32(0x20202020)


def _grams(col):
    """(first row, last row, grams, ends): for each run of rows their byte
    grams and where each row's grams end.  Every row is padded with spaces."""
    offs, data = text_buffers(col)
    pad = GRAM - 2
    for lo, hi in row_chunks(offs, _CHUNK):
        size = np.diff(offs[lo:hi + 1])
        n = hi - lo
        buf = np.full(int(size.sum()) + 2 * pad * n, 32, np.uint8)
        at = np.cumsum(size) - size + pad * (2 * np.arange(n) + 1)
        put = np.repeat(at - (offs[lo:hi] - offs[lo]), size) + np.arange(int(size.sum()))
        buf[put] = _LETTERS[data[offs[lo]:offs[hi]]]
        g = np.zeros(max(0, len(buf) - GRAM + 1), np.uint32)
        for i in range(GRAM):
            g = (g << np.uint32(8)) | buf[i:len(buf) - GRAM + 1 + i]
        row = np.repeat(np.arange(n), size + 2 * pad)[:len(g)]
        keep = (g != _SPACES) & (row == np.repeat(np.arange(n), size + 2 * pad)[GRAM - 1:])
        g, row = g[keep], row[keep]
        yield lo, hi, g, np.searchsorted(row, np.arange(n + 1))


def _count(langs: list[str]):
    code = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            lang = np.array([code[x] for x in b.column("lang").to_pylist()], np.int64)
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi, g, ends in _grams(b.column("text")):
                key = np.repeat(lang[lo:hi], np.diff(ends)) << 32 | g.astype(np.int64)
                c = pd.Series(key).value_counts(sort=False)
                parts.append((c.index.to_numpy(), c.to_numpy()))
            if parts:
                s = pd.Series(np.concatenate([p[1] for p in parts])).groupby(np.concatenate([p[0] for p in parts])).sum()
                k = s.index.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array(k & 0xFFFFFFFF),
                                                  pa.array(s.to_numpy().astype(np.int64))], ["lang", "gram", "n"])
    return run


def gram_slots(g: np.ndarray) -> list[np.ndarray]:
    """The slots of each gram, one array a hash function."""
    out, h = [], g.astype(np.uint64)
    for i in range(HASHES):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        out.append((h % np.uint64(SLOTS)).astype(np.int64))
    return out


def _place(batches):
    for b in batches:
        g = np.array(b.column("gram"), np.int64)
        lang = np.array(b.column("lang"), np.int32)
        for s in gram_slots(g):
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(lang)], ["slot", "lang"])


class Model:
    """langs: the learned values in code-point order; rows: slots x bytes of
    language bits; false_rate: chance that a gram foreign to a language seems
    to be in it; prior: number of the most frequent language."""

    def __init__(self, langs: list[str], rows: np.ndarray, prior: int):
        self.langs, self.rows, self.prior = langs, rows, prior
        bits = np.unpackbits(rows, axis=1, bitorder="little", count=max(len(langs), 1))
        self.false_rate = bits.mean(0) ** HASHES


def learn(docs: DataFrame, share: float = SHARE) -> Model:
    """The model of the rows of ``docs`` that have a text and a lang."""
    text_batches(docs.sparkSession)
    d = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in d.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    rows = np.zeros((SLOTS, max(1, -(-len(langs) // 8))), np.uint8)
    if not langs:
        return Model(langs, rows, 0)
    grams = d.mapInArrow(_count(langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = saved(grams, "grams")  # a row a gram and language
    total = {r[0]: r[1] for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    freq = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in total.items() for x in (k, float(v))]), F.col("lang"))
    top = (grams.withColumn("f", freq).groupBy("gram").agg(F.collect_list(F.struct("lang", "f")).alias("l"), F.max("f").alias("m"))
           .select("gram", F.explode(F.filter("l", lambda x: x["f"] >= F.col("m") * share)["lang"]).alias("lang")))
    placed = top.mapInArrow(_place, "slot long, lang int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("lang") % 8 + 1)
    byte = [F.bit_or(F.when(F.floor(F.col("lang") / 8) == w, bit).otherwise(0)).alias(f"b{w}") for w in range(rows.shape[1])]
    got = placed.groupBy("slot").agg(*byte).toPandas()  # at most one row a slot
    for w in range(rows.shape[1]):
        rows[got["slot"].to_numpy(), w] = got[f"b{w}"].to_numpy().astype(np.uint8)
    return Model(langs, rows, langs.index(max(langs, key=lambda x: (counts[x], x))))


def _predict(model_b):
    def run(batches):
        m: Model = model_b.value
        n_lang = len(m.langs)
        for b in batches:
            col = b.column("text")
            pred, score = [], []
            for lo, hi, g, ends in _grams(col):
                hit = None
                for s in gram_slots(g):
                    hit = m.rows[s] if hit is None else hit & m.rows[s]
                n = np.diff(ends)
                run_sum = np.zeros(len(g) + 1, np.int64)
                found = np.zeros((hi - lo, n_lang))
                for x in range(n_lang):
                    np.cumsum(hit[:, x // 8] >> (x % 8) & 1, out=run_sum[1:])
                    found[:, x] = run_sum[ends[1:]] - run_sum[ends[:-1]]
                real = np.clip((found - n[:, None] * m.false_rate[:n_lang]) / np.maximum(1 - m.false_rate[:n_lang], 1e-9), 0, None)
                for i in range(hi - lo):
                    text = col[lo + i].as_py()
                    if not n_lang or text is None or not any(map(str.isalpha, text)):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(np.argmax(real[i])) if n[i] and real[i].max() > 0 else m.prior
                    pred.append(m.langs[best])
                    score.append(float(min(1.0, real[i][best] / max(1, n[i]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names),
                                              pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*b.schema.names, "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, the share of the text's grams that
    the predicted language has.

    Defined cases: a null text or one without a letter is ``und`` with score 0;
    a text with letters but no known gram gets the most frequent language and
    score 0; ties go to the first language by code point; texts of any length
    count whole; rows are independent, so repeated rows agree; with nothing
    learned every text is ``und``.  Input columns named as the outputs are replaced.
    """
    text_batches(docs.sparkSession)
    b = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.drop("lang_pred", "score")
    schema = T.StructType([*d.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return d.mapInArrow(_predict(b), schema)


def id_hash(mod: int):
    """crc32 of the id as text (a null id: of the empty text), modulo ``mod``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = id_hash(4) == 2
    model = learn(docs.where(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")
