"""Operator 11 against brute force: fingerprints, links and components."""
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leverkit.llm import simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids, distance):
    least = list(ids)
    near = [[j for j, y in enumerate(fps) if (x ^ y).bit_count() <= distance] for x in fps]
    while True:
        new = [min((least[j] for j in js if least[j] is not None), default=None) for js in near]
        if new == least:
            return least
        least = new


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "的", "😀"]
    base = [[r.choice(words) for _ in range(r.randint(60, 400))] for _ in range(6)]
    out = []
    for i in range(150):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(words)
        out.append((i, "\t\n ".join([" ".join(t[:9]), " ".join(t[9:]).upper()])))
    out += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "one two three four"),
            (None, out[0][1]), (None, "alone without an id"), (0, out[0][1]), (950, " ".join(r.choice(words) for _ in range(60_000)))]
    return out


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"width": 3}, {"width": 4, "block": 5}, {"distance": 6, "shingle": 2}])
def test_components(spark, rows, how):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("fp", "key", "label", "low", "fingerprint", "component_id")})
    got = sorted(map(tuple, simhash.simhash_components(df, **how).collect()), key=repr)
    fps = [fingerprint(t, how.get("shingle", 4)) for _, t in rows]
    low = components(fps, [i for i, _ in rows], how.get("distance", 4))
    want = sorted([(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, low)], key=repr)
    assert got == want
    assert len({c for *_, c in want}) < len(set(fps)) < len(rows)  # copies, and links beyond copies


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOC)).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_components(spark.createDataFrame([], DOC), distance=7)


def cloud(n, bits, seed):
    """n distinct fingerprints around one, up to ``bits`` bits away from it."""
    r, out = random.Random(seed), set()
    while len(out) < n:
        x = 0x0123456789ABCDEF
        for b in r.sample(range(64), r.randint(1, bits)):
            x ^= 1 << b
        out.add(x)
    return np.array(sorted(out), np.uint64)


def connected(edges, fps):
    label = {x: x for x in fps.tolist()}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in edges:
        label[top(a)] = top(b)
    return sorted(sorted(x for x in label if top(x) == t) for t in {top(x) for x in label})


@pytest.mark.parametrize("n,bits", [(40, 3), (400, 8), (600, 20)])
def test_forest(n, bits):
    fps = cloud(n, bits, n)
    a, b = simhash.forest(fps, 4)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert len(a) < n  # a forest, not all links
    assert connected(zip(a.tolist(), b.tolist()), fps) == connected(zip(fps[i].tolist(), fps[j].tolist()), fps)


def test_large_group_makes_few_rows(spark):
    """2,000 different fingerprints close to one another: the index returns
    a forest a key, never their pairs, and blocks do not change the result."""
    fps = cloud(2000, 5, 1)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    whole = connected(zip(fps[i].tolist(), fps[j].tolist()), fps)
    for block in (simhash.BLOCK, 100):
        got = simhash.links(df, len(fps), block=block).collect()
        edges = [(r.a % 2**64, r.b % 2**64) for r in got]
        assert connected(edges, fps) == whole
        if block == simhash.BLOCK:
            assert len(got) < 15 * len(fps) < len(i)


def test_count_filter():
    """No link is lost by the tally, and the joint keys meet every link."""
    r = random.Random(7)
    x = np.array([sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(20_000)], np.uint64)
    assert (simhash.linked(x, 4) == (np.bitwise_count(x) <= 4)).all()
    assert simhash.key_width(10**6, 4) == 2 and simhash.key_width(10**9, 4) == 3 and simhash.key_width(10**11, 4) == 4
    near = x[np.bitwise_count(x) <= 4]
    for width in (2, 3, 4):
        equal = sum((near >> np.uint64(8 * k)) & np.uint64(255) == 0 for k in range(4 + width))
        assert (equal >= width).all()
