"""Word hashes: equal words hash alike wherever they stand; words that a
polynomial modulo 2^64 confuses do not."""
import random
import time
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leverkit.llm import jaccard
from leverkit.llm.common import SHUFFLE_CLEANUP, SPACE_WORDS, saved, scan_words, spaced_words


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n]


def swapped(t):
    return t.translate(str.maketrans("ab", "ba"))


def hashes(texts, **how):
    return [int(h) for c in scan_words(pa.array(texts, pa.string()), SPACE_WORDS, **how) for h in c.hash]


@pytest.mark.parametrize("n", [8, 255, 256, 1024, 4096])
def test_structural_collision(n):
    t = thue_morse(n)
    a, b, again = hashes([t, swapped(t), "x " + t])[:3:1][0], hashes([swapped(t)])[0], hashes(["x " + t])[1]
    assert a != b and a == again


def test_same_word_same_hash():
    r = random.Random(1)
    words = ["".join(r.choice("abé的") for _ in range(r.choice([1, 5, 100, 127, 128, 300, 700]))) for _ in range(40)]
    order = [r.choice(words) for _ in range(300)]
    texts = [" ".join(order[i:i + 7]) for i in range(0, 300, 7)] + [None, ""]
    got = hashes(texts, limit=900)
    assert len(got) == 300 and len(set(zip(order, got))) == len(set(order)) == len(set(got))


def test_spaced_words():
    texts = ["  One\ttwo  é\n", None, "x", "a  b c", ""]
    for c in scan_words(pa.array(texts, pa.string()), SPACE_WORDS, limit=8):
        buf, start, end = spaced_words(c)
        for i in range(c.hi - c.lo):
            a, b = c.first[i], c.first[i + 1]
            assert (buf[start[a]:end[b - 1]] if b > a else b"").decode() == " ".join((texts[c.lo + i] or "").lower().split())


def test_long_words_do_not_link(spark):
    t = thue_morse(1024)
    df = spark.createDataFrame([(1, f"{t} same words here"), (2, f"{swapped(t)} other words there"), (3, t), (4, swapped(t)), (5, t.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_chunks_take_little_memory():
    texts = pa.array([f"some words of text {i} " * 100 for i in range(2000)])
    tracemalloc.start()
    try:
        assert sum(len(c.hash) for c in scan_words(texts, SPACE_WORDS)) == 2000 * 500
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20, peak


def test_saved_leaves_no_shuffle_files(spark):
    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in dirs for f in d.rglob("shuffle_*.data")}

    before, conf = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    got = saved(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s")))
    until = time.time() + 20
    while files() - before and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert not files() - before
    assert {r.k: r.s for r in got.collect()} == {k: sum(range(k, 1000, 10)) for k in range(10)}
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == conf
