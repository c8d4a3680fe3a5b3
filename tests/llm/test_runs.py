"""Operator 13 against brute force; the grammar's extensions by themselves."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leverkit.llm import runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    found = brute_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def periodic_words(r, n, letters):
    w = []
    while len(w) < n:
        if w and r.random() < 0.3:
            p = r.randint(1, min(len(w), 12))
            for _ in range(r.randint(1, 40)):
                w.append(w[-p])
        else:
            w.append(r.randrange(letters))
    return w[:n]


@pytest.mark.parametrize("seed", range(20))
def test_find_runs(seed):
    r = random.Random(seed)
    texts = [periodic_words(r, r.choice([0, 1, 11, 12, 13, 40, 200]), r.choice([1, 2, 3, 40])) for _ in range(6)]
    cut = np.cumsum([0] + [len(w) for w in texts])
    got = runs.find_runs(np.array(sum(texts, []), np.int64), cut)
    assert got.tolist() == [[d, *x] for d, w in enumerate(texts) for x in brute_runs(w)]


def test_candidates_in_slices(monkeypatch):
    r = random.Random(99)
    w = periodic_words(r, 500, 3)
    whole = runs.find_runs(np.array(w), np.array([0, 500]))
    monkeypatch.setattr(runs, "CANDIDATES", 37)
    assert (runs.find_runs(np.array(w), np.array([0, 500])) == whole).all() and len(whole) > 5


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("w", [[0] * 300, fibonacci(300), periodic_words(random.Random(1), 300, 2), list(range(300)), [0, 1] * 150])
def test_extensions(w):
    g = runs.Grammar(np.array(w))
    a, b = map(np.array, zip(*[(i, j) for i in range(0, 300, 7) for j in range(i + 1, 301, 5)]))
    right = [next((k for k in range(300 - j) if w[i + k] != w[j + k]), 300 - j) for i, j in zip(a.tolist(), b.tolist())]
    left = [next((k for k in range(i) if w[i - 1 - k] != w[j - 1 - k]), i) for i, j in zip(a.tolist(), b.tolist())]
    assert g.extend(a, b).tolist() == right and g.extend(a, b, True).tolist() == left
    assert len(g.sym) < 8 * len(w) and g.levels < 40


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    word = lambda x: ["a", "B", "的", "b", "é"][x % 5] + str(x // 5)
    sep = lambda: r.choice([" ", "  ", "\n", "\t \r\n"])
    out = [(i, "".join(word(x) + sep() for x in periodic_words(r, r.choice([3, 30, 150]), r.choice([2, 30, 400])))) for i in range(150)]
    out += [(None, out[0][1]), (out[1][0], out[1][1]), (500, None), (501, ""), (502, " \n\x0b "), (503, "x"), (504, " ".join("ab" * 6)), (505, "A a " * 6),
            (506, " ".join(f"u{i}" for i in range(30_000)) + " tail words" * 40), (507, "x " * 5000)]
    return out


def test_periodic_runs(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("start", "runs", "length", "period", "n_runs", "collapsed")})
    small = {506, 507}
    got = sorted((tuple(r) for r in runs.periodic_runs(df, plant=True, whole=False).collect() if r.doc_id not in small), key=repr)
    want = [brute_row(i, t) for i, t in rows if i not in small]
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 30 and any(r[1] > 1 for r in got)
    long = {r.doc_id: r for r in runs.periodic_runs(df).where("doc_id in (506, 507)").collect()}
    assert [tuple(x) for x in long[506].runs] == [(30_000, 80, 2)] and long[506].collapsed.endswith("u29999 tail words")
    assert [tuple(x) for x in long[507].runs] == [(0, 5000, 1)] and long[507].collapsed == "x" and long[507].exponent_milli == 5_000_000


def test_plain_rows(spark, rows):
    """Without planting, runs and collapsed texts themselves."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows[:60]], DOC)
    for r in runs.periodic_runs(df).collect():
        text = dict(rows[:60])[r.doc_id]
        assert [tuple(x) for x in r.runs] == brute_runs(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 == brute_row(r.doc_id, text, False)[-1]
    assert runs.periodic_runs(spark.createDataFrame([], DOC)).collect() == []


def test_structural_hash_collision(spark):
    """Two long words that a polynomial hash modulo 2^64 cannot tell apart
    (Thue-Morse and its complement) are two words here."""
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    text = " ".join(" ".join([x, *"cdefgh"]) for x in (t, u))
    assert runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_runs == 0
