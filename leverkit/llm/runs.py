"""Operator 13: maximal periodic runs of words, found by recompression.

The words of a batch of texts stand in one sequence, texts kept apart by
symbols of their own.  Recompression turns it into a run-length grammar: in
turn, maximal blocks of one symbol become one symbol each, then the alphabet is
cut in two halves and each pair "left half, right half" becomes one symbol.
Symbols are named by what they stand for, so equal symbols have equal words.

How far the words from two places agree (their longest common extension, to
the right or to the left) is read off the levels of the grammar: climb while
both places are at symbol bounds of the next level, step over equal symbols (a
block in one step), and climb down where they differ.  It is exact whatever
the grammar; a good one makes it short.

A run of period q and length 2q or more covers two neighbouring points of the
grid 0, q, 2q, ...  So the candidates are all (point, next point) of the grids
of all periods, n log n of them.  A run of 12 words or more agrees with itself
q words on in at least 6 places in a row, which most candidates fail at once;
both extensions of the rest give the whole run.  A period that is a multiple of
the smallest gives the same words, so the smallest period found for a stretch
is kept.

Texts are independent: nothing is shuffled.  A text without a repeated 6-word
gram has no run and needs no grammar.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import SPACE_WORDS, importable, mix, scan_words, shingle_hashes, spaced_words, table, text_batches

#: words of the shortest run, and the words in a row that agree with those one period on in any run
LEAST = 12
AGREE = LEAST // 2
#: candidates looked at together; sequences of at most TOP symbols are not compressed further
CANDIDATES = 1 << 19
TOP = 4


# ---------------------------------------------------------------- grammar

def _names(key: np.ndarray, used: int) -> tuple[np.ndarray, int]:
    u, name = np.unique(key, return_inverse=True)
    return used + name.ravel(), used + len(u)


class Grammar:
    """Levels of a run-length grammar over ``words`` (non-negative integers).

    Level l holds symbols from ``first[l]`` on; ``key`` is l * (n + 1) + the
    place where a symbol begins (one more entry ends each level), ``sym`` its
    name, ``size`` its words, ``ahead`` / ``behind`` how many symbols of its
    block begin / end with it.
    """

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        sym, place, used, level = words.astype(np.int64), np.arange(n), int(words.max(initial=-1)) + 1, 0
        keys, syms, sizes, ahead, behind = [], [], [], [], []
        while True:
            size = np.diff(np.append(place, n))
            new = np.ones(len(sym), bool)
            new[1:] = sym[1:] != sym[:-1]
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(sym)))
            i = np.arange(len(sym)) - np.repeat(head, count)
            keys.append(level * (n + 1) + np.append(place, n))
            syms.append(np.append(sym, -1))
            sizes.append(np.append(size, 0))
            behind.append(np.append(i + 1, 0))
            ahead.append(np.append(np.repeat(count, count) - i, 0))
            level += 1
            if len(sym) <= TOP:
                break
            # blocks
            sym, place = sym[head], place[head]
            long = count > 1
            sym[long], used = _names(sym[long] << 32 | count[long], used)
            # pairs: halves by a bit of the symbol's hash, the order that makes more pairs
            half = (mix(sym.astype(np.uint64) + np.uint64(level << 40)) & np.uint64(1)).astype(bool)
            one, two = half[:-1] & ~half[1:], ~half[:-1] & half[1:]
            at = np.flatnonzero(one if one.sum() >= two.sum() else two)
            if len(at):
                sym[at], used = _names(sym[at] << 32 | sym[at + 1], used)
                keep = np.ones(len(sym), bool)
                keep[at + 1] = False
                sym, place = sym[keep], place[keep]
        self.levels = level
        self.key, self.sym, self.size, self.ahead, self.behind = (np.concatenate(x) for x in (keys, syms, sizes, ahead, behind))

    def extend(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from places a < b on (or, back, before them)."""
        n, sign, block = self.n, -1 if back else 1, self.behind if back else self.ahead
        got, level, up, live = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, lv = a[live] + sign * got[live], b[live] + sign * got[live], level[live]
            base = lv * (n + 1)
            climb = up[live] & (lv + 1 < self.levels)
            for z in (x, y):
                k = base[climb] + n + 1 + z[climb]
                climb[climb] = self.key[np.searchsorted(self.key, k)] == k
            level[live[climb]] += 1
            rest = live[~climb]
            i, j = (np.searchsorted(self.key, base[~climb] + z[~climb]) - back for z in (x, y))
            same = self.sym[i] == self.sym[j]
            got[rest[same]] += np.minimum(block[i], block[j])[same] * self.size[i[same]]
            down = rest[~same]
            up[down] = False
            level[down] -= 1
            live = live[level[live] >= 0]
        return got


# ---------------------------------------------------------------- runs

def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid points with a next one, for n words, a
    bounded number at a time."""
    lo, periods = 1, n // 2
    count = (n - 1) // np.arange(1, periods + 1)
    total = np.cumsum(count)
    while lo <= periods:
        done = total[lo - 2] if lo > 1 else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + CANDIDATES, "right")) + 1)
        p = np.arange(lo, min(hi, periods + 1))
        c = count[p - 1]
        period = np.repeat(p, c)
        yield (np.arange(len(period)) - np.repeat(np.cumsum(c) - c, c)) * period, period
        lo = hi


def find_runs(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """All maximal runs of the texts ``words[texts[i]:texts[i + 1]]`` as rows
    (text, start, length, period), by text, start and period."""
    n = np.diff(texts)
    out = [np.zeros((0, 4), np.int64)]
    # each text is followed by a symbol of its own, and AGREE more at the end
    row = np.repeat(np.arange(len(n)), n)
    lone = int(words.max(initial=-1)) + 1
    seq = np.arange(lone, lone + len(words) + len(n) + AGREE)
    at = np.arange(len(words)) + row
    seq[at] = words
    head = texts[:-1] + np.arange(len(n))
    grammar = None
    for t in np.flatnonzero(n >= LEAST):
        for i, p in _grids(int(n[t])):
            i = i + head[t]
            ok = seq[i] == seq[i + p]
            i, p = i[ok], p[ok]
            # places in a row that agree, this one included, looked at up to AGREE
            right, left, on, off = np.ones(len(i), np.int64), np.zeros(len(i), np.int64), np.ones(len(i), bool), np.ones(len(i), bool)
            for k in range(1, AGREE):
                on &= seq[i + k] == seq[i + k + p]
                off &= (i - k >= head[t]) & (seq[i - k] == seq[i - k + p])
                right += on
                left += off
            ok = right + left >= AGREE
            i, p = i[ok], p[ok]
            if not len(i):
                continue
            grammar = grammar or Grammar(seq)
            # a point whose neighbour before it agrees with it over a whole period is in that one's run
            right = grammar.extend(i, i + p)
            covered = np.zeros(len(i), bool)
            covered[1:] = (p[1:] == p[:-1]) & (i[1:] == i[:-1] + p[1:]) & (right[:-1] >= p[1:])
            i, p, right = i[~covered], p[~covered], right[~covered]
            left = grammar.extend(i, i + p, True)
            length = left + p + right
            ok = length >= np.maximum(LEAST, 2 * p)
            out.append(np.column_stack([np.full(ok.sum(), t), (i - left - head[t])[ok], length[ok], p[ok]]))
    runs = np.concatenate(out)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)  # the smallest period of a stretch
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run, or in the first period of all
    runs that hold them."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


# ---------------------------------------------------------------- operator

def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on repeat those of one period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_FIELDS = ("n_runs", "start", "length", "period", "exponent_milli")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _FIELDS) + ", runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _chunk_rows(ids: list, c, plant: bool) -> Iterator[tuple]:
    buf, start, end = spaced_words(c)
    first, n = c.first, np.diff(c.first)
    source = np.arange(first[0], first[-1])
    changed = set()
    for j, doc_id in enumerate(ids):
        got = planted(doc_id, int(n[j])) if plant else None
        if got:
            a, p = got
            i = np.arange(a, n[j])
            source[first[j] + i] = first[j] + a + (i - a) % p
            changed.add(j)
    # texts in which some AGREE words come twice (or seem to, by their hash)
    row = np.repeat(np.arange(len(n)), n)
    gram = shingle_hashes(c.hash[source], AGREE)
    whole = row[AGREE - 1:] == row[:len(gram)]
    gram, of = gram[whole], row[:len(gram)][whole]
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    twice = np.unique(of[1:][(gram[1:] == gram[:-1]) & (of[1:] == of[:-1])])
    # exact words of those texts only
    names: dict[bytes, int] = {}
    ids_of = [np.fromiter((names.setdefault(buf[start[k]:end[k]], len(names)) for k in source[first[j]:first[j + 1]]), np.int64, n[j]) for j in twice]
    texts = np.concatenate([[0], np.cumsum(n[twice])]).astype(np.int64)
    runs = find_runs(np.concatenate([np.zeros(0, np.int64), *ids_of]), texts)
    cut = dict(zip(twice.tolist(), np.split(runs[:, 1:], np.searchsorted(runs[:, 0], np.arange(1, len(twice)))), strict=True)) if len(twice) else {}
    none = np.zeros((0, 3), np.int64)
    for j, doc_id in enumerate(ids):
        mine = cut.get(j, none)
        if len(mine) or j in changed:
            k = source[first[j]:first[j + 1]][collapsed(int(n[j]), mine)]
            text = b" ".join([buf[start[i]:end[i]] for i in k])
        else:
            text = buf[start[first[j]]:end[first[j + 1] - 1]] if n[j] else b""
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in mine.tolist())
        best = [None] * 4
        if len(mine):
            s, m, q = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
            best = [s, m, q, 1000 * m // q]
        yield (doc_id, len(mine), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
               [dict(zip(("start", "length", "period"), x, strict=True)) for x in mine.tolist()], text)


def _runs(plant: bool, whole: bool):
    names = ["doc_id", *_FIELDS, "runs_sha256", "collapsed_sha256", "runs", "collapsed"][:None if whole else 8]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for c in scan_words(b.column("text"), SPACE_WORDS, lower=False):
                cols = list(zip(*_chunk_rows(ids[c.lo:c.hi], c, plant), strict=True))
                if cols and whole:
                    cols[9] = [x.decode("utf-8", "replace") for x in cols[9]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols[:len(names)], kinds, strict=False)], names)
    return run


def periodic_runs(docs: DataFrame, plant: bool = False, whole: bool = True) -> DataFrame:
    """One row a document: doc_id, n_runs, start, length, period and
    exponent_milli of the longest run (ties: smallest start, then period),
    runs_sha256 and collapsed_sha256, and, if ``whole``, the runs and the
    collapsed text themselves.  ``plant`` first repeats a period in the
    documents whose hashed id says so, as the query's contract asks.

    Defined cases: null, empty and word-free texts have no words and no run,
    and collapse to the empty text; texts of any length are read whole, one
    text in one task; repeated rows each get a row; a null doc_id stays null
    and nothing is planted there; an empty table gives no rows; further columns
    are not looked at.
    """
    spark = docs.sparkSession
    importable(spark)
    text_batches(spark)
    schema = _SCHEMA if whole else _SCHEMA[:_SCHEMA.index(", runs array")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runs(plant, whole), schema)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True, whole=False)


# a run of period q repeats each of its 6-word grams q words on, in at least 6
# places in a row; crc32 is written out bit by bit (a byte, then eight shifts)
ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
             lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h
  FROM documents),
m AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % len(w) AS a,
             1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM w),
t AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])
                           ELSE w END AS w FROM m),
g AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM (SELECT r, w, unnest(range(n - 5)) AS i FROM t WHERE n >= 12)),
b AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
f AS (SELECT r, min(i) AS start, count(*) + 5 + q AS length, q
      FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM b) GROUP BY r, q, k
      HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
u AS (SELECT r, start, length, min(q) AS period FROM f GROUP BY r, start, length),
v AS (SELECT r, count(*) AS n_runs, arg_min({s: start, m: length, p: period}, {a: -length, b: start, c: period}) AS top,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
x AS (SELECT r, i, any_value(c) AS c FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS c FROM t) GROUP BY r, i),
d AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT x.r, string_agg(x.c, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN d ON d.r = x.r AND d.i = x.i WHERE d.r IS NULL GROUP BY x.r)
SELECT t.doc_id, coalesce(v.n_runs, 0) AS n_runs, v.top.s AS start, v.top.m AS length, v.top.p AS period,
       1000 * v.top.m // v.top.p AS exponent_milli, sha256(coalesce(v.lines, '')) AS runs_sha256,
       sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM t LEFT JOIN v USING (r) LEFT JOIN k USING (r)
"""
