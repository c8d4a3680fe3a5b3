"""Operator 8: language-model scoring by context-tree weighting.

A text is its UTF-8 bytes (A-Z lower-cased) and an end mark.  Each byte is
eight binary decisions; every decision has a context tree of its own, told
apart by the bits already seen of the byte.  A node of a tree is the last d
bytes (d = 0 .. DEPTH); it holds the counts of the two bits after that context
in training and their Krichevsky-Trofimov (KT) block probability.  The weighted
probability of a node is the mean of its KT probability and the product of its
children's weighted probabilities; a bit is predicted by the mixture of the KT
estimates of all depths that those weights imply.  A context that training
never saw adds nothing: the deepest seen one stands in for it.

As Spark jobs, with no part of the model on the driver or in one task:

1. documents are cut into chunks of rows of a bounded number of bytes.  A chunk
   lists its distinct (context, byte) grams with their training counts, and its
   distinct words with theirs;
2. grams are dealt out by their last two context bytes, so that the subtree
   below depth two is whole in one task; each task merges the lists and weighs
   its subtrees from the leaves up.  Depths 0 and 1 have at most 256 x 255
   nodes and are added up over the tasks;
3. each task then sends every chunk the log-probabilities of the chunk's own
   grams, in the chunk's order; words get their counts in the same way;
4. chunks look up their texts.

The lists are sorted, differenced and compressed, so what moves is the distinct
grams and words of the chunks, not the occurrences.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import LOWER, SPACE_WORDS, row_chunks, saved, scan_words, table, text_batches, text_buffers
from leverkit.llm.langid import id_hash

DEPTH = 5
CHUNK_TEXT = 12 << 20
#: bytes looked at together inside a chunk
STEP = 2 << 20
END = 0xFF  # no UTF-8 text holds this byte
ALPHA = 0.1

_HALF = math.lgamma(0.5)
_TABLE = 1 << 12
_LGAMMA = np.array([math.lgamma(i + 0.5) for i in range(_TABLE)])
_LGAMMA1 = np.array([math.lgamma(i + 1.0) for i in range(_TABLE)])


def _lgamma(n: np.ndarray, shift: float, small: np.ndarray) -> np.ndarray:
    """lgamma(n + shift) of counts: exact below 4096, else Stirling's series."""
    x = np.maximum(n, 1) + shift
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _TABLE, small[np.minimum(n, _TABLE - 1)], big)


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of any sequence of a zeros and b ones."""
    return _lgamma(a, 0.5, _LGAMMA) + _lgamma(b, 0.5, _LGAMMA) - _lgamma(a + b, 1.0, _LGAMMA1) - 2 * _HALF


# ---------------------------------------------------------------- packed lists

def _planes(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(blob: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(blob[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def _pack(sorted_keys: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(blob, np.uint64), dtype=np.uint64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(inv, np.concatenate(counts), len(u)).round().astype(np.int64)


# ---------------------------------------------------------------- grams

def _grams(offs: np.ndarray, data: np.ndarray, depth: int):
    """(first row, last row, grams, ends) of runs of rows.  A gram is the last
    ``depth`` bytes before a byte, the latest on top, then the byte; a text is
    followed by END and preceded by END bytes."""
    for lo, hi in row_chunks(offs, STEP):
        size = np.diff(offs[lo:hi + 1])
        n, total = hi - lo, int(size.sum())
        buf = np.full(total + n + depth, END, np.uint8)
        put = np.repeat(depth + np.arange(n) - (offs[lo:hi] - offs[lo]) + (np.cumsum(size) - size), size) + np.arange(total)
        buf[put] = LOWER[data[offs[lo]:offs[hi]]]
        ends = np.concatenate([[0], np.cumsum(size + 1)])
        g = buf[depth:].astype(np.uint64)
        # how many bytes of the same text stand before each byte
        since = np.arange(len(g)) - np.repeat(ends[:-1], size + 1)
        for d in range(1, depth + 1):
            c = np.where(since >= d, buf[depth - d:len(buf) - d], np.uint8(END)).astype(np.uint64)
            g |= c << np.uint64(8 * (depth + 1 - d))
        yield lo, hi, g, ends


def _shard(grams: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """By the last two context bytes."""
    top = grams >> np.uint64(8 * (depth - 1))
    return (top * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return (words >> np.uint64(7)) % np.uint64(shards)


_LIST = pa.list_(pa.struct([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _distinct_grams(offs, data, depth, train):
    keys, counts = [], []
    for lo, hi, g, ends in _grams(offs, data, depth):
        codes, u = pd.factorize(g)
        keys.append(u)
        counts.append(np.bincount(codes, np.repeat(train[lo:hi], np.diff(ends)), len(u)))
        if len(keys) == 8:
            k, c = _merge(keys, counts)
            keys, counts = [k], [c]
    return _merge(keys, counts)


def _cut_chunks(depth: int, shards: int):
    def run(batches):
        part, made = None, 0
        for b in batches:
            if part is None:
                from pyspark import TaskContext
                part = TaskContext.get().partitionId()
            offs, _ = text_buffers(b.column("text"))
            for lo, hi in row_chunks(offs, CHUNK_TEXT):
                rows = b.slice(lo, hi - lo)
                col, train = rows.column("text"), ~np.array(rows.column("held_out"), bool)
                o, data = text_buffers(col)
                grams = _distinct_grams(o, data, depth, train)
                keys, counts, ends = [], [], 0
                for c in scan_words(col, SPACE_WORDS):
                    u, inv = np.unique(c.hash, return_inverse=True)
                    keys.append(u)
                    counts.append(np.bincount(inv, np.repeat(train[c.lo:c.hi], np.diff(c.first)), len(u)))
                words = _merge(keys, counts)
                ends = int(train.sum())
                lists = []
                for kind, (k, n), of in ((0, grams, _shard(grams[0], depth, shards)), (1, words, _word_shard(words[0], shards))):
                    for s in np.unique(of):
                        at = of == s
                        lists.append({"kind": kind, "shard": int(s), "keys": _pack(k[at]), "counts": _planes(n[at])})
                text = data[o[0]:o[-1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | made]), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                     pa.array([(~train).tolist()], pa.list_(pa.bool_())), pa.array([np.diff(o).tolist()], pa.list_(pa.int64())),
                     pa.array([len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)], pa.binary()),
                     pa.array([ends]), pa.array([lists], _LIST)],
                    ["chunk", "ids", "out", "sizes", "text", "ends", "lists"])
                made += 1
    return run


_CHUNKS = ("chunk long, ids array<long>, out array<boolean>, sizes array<long>, text binary, ends long, "
           "lists array<struct<kind:int,shard:int,keys:binary,counts:binary>>")


# ---------------------------------------------------------------- the tree

class _Level:
    """Distinct (context of d bytes, byte) with counts; ``up`` maps to the next shallower level."""

    def __init__(self, keys, n):
        self.keys, self.n, self.up = keys, n, None


def _levels(keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> dict[int, _Level]:
    out = {depth: _Level(keys, n)}
    for d in range(depth - 1, least - 1, -1):
        low = out[d + 1]
        # drop the oldest context byte, which stands above the byte
        k = (low.keys >> np.uint64(16) << np.uint64(8)) | (low.keys & np.uint64(0xFF))
        u, low.up = np.unique(k, return_inverse=True)
        out[d] = _Level(u, np.bincount(low.up, low.n, len(u)).round().astype(np.int64))
    return out


def _nodes(lv: _Level, bit: int):
    """Nodes of decision ``bit`` (0 is the highest): first elements, node of
    each element, zeros and ones, and each element's own bit."""
    key = lv.keys >> np.uint64(8 - bit)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    own = (lv.keys >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
    ones = np.add.reduceat(lv.n * own, start)
    zeros = np.add.reduceat(lv.n, start) - ones
    return start, node, zeros, ones, own


def _weigh(levels: dict[int, _Level], depth: int, least: int, bit: int):
    """Per level: (node, zeros, ones, own bit, weight of the node's own KT
    estimate against its children, log weighted probability, first elements)."""
    out, below = {}, None
    for d in range(depth, least - 1, -1):
        start, node, zeros, ones, own = _nodes(levels[d], bit)
        kt = kt_block(zeros, ones)
        if below is None:
            weight, lpw = np.ones(len(kt)), kt
        else:
            kids = np.bincount(node[levels[d + 1].up[below[6]]], below[5], len(kt))
            lpw = math.log(0.5) + np.logaddexp(kt, kids)
            weight = 1 / (1 + np.exp(np.clip(kids - kt, -700, 700)))
        out[d] = below = (node, zeros, ones, own, weight, lpw, start)
    return out


def _top_sums(depth: int):
    """Depth-1 sums of a task's subtrees: latest byte, decision node (1 followed
    by the bits seen), zeros, ones and log weighted probabilities of the depth-2 nodes."""
    def run(t: pa.Table) -> pa.Table:
        keys, n = _merge([_unpack(x) for x in t["keys"].to_pylist()], [_unplanes(x, np.int64) for x in t["counts"].to_pylist()])
        levels = _levels(keys, n, depth, 2)
        out = []
        for bit in range(8):
            _, zeros, ones, _, _, lpw, start = _weigh(levels, depth, 2, bit)[2]
            k = levels[2].keys[start]
            latest = (k >> np.uint64(16)).astype(np.int64)
            tree = (1 << bit) + ((k & np.uint64(0xFF)) >> np.uint64(8 - bit)).astype(np.int64)
            df = pd.DataFrame({"latest": latest, "tree": tree, "zeros": zeros, "ones": ones, "lpw": lpw})
            out.append(df.groupby(["latest", "tree"], as_index=False).sum())
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False)
    return run


def _top_tables(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts[d][latest, tree, bit], weight[d][latest, tree] for d = 0, 1
    (depth 0 uses row 0), from at most 256 x 255 rows."""
    counts = np.zeros((2, 256, 256, 2), np.int64)
    kids = np.zeros((2, 256, 256))
    a, t = sums["latest"].to_numpy(), sums["tree"].to_numpy()
    counts[1, a, t, 0], counts[1, a, t, 1], kids[1, a, t] = sums["zeros"], sums["ones"], sums["lpw"]
    kt = np.zeros((2, 256, 256))
    kt[1] = kt_block(counts[1, :, :, 0], counts[1, :, :, 1])
    lpw = math.log(0.5) + np.logaddexp(kt[1], kids[1])
    counts[0, 0] = counts[1].sum(0)
    kids[0, 0] = lpw.sum(0)
    kt[0] = kt_block(counts[0, :, :, 0], counts[0, :, :, 1])
    return counts, 1 / (1 + np.exp(np.clip(kids - kt, -700, 700))), kt


def log10_probabilities(keys: np.ndarray, n: np.ndarray, depth: int, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each gram's byte after its context."""
    levels = _levels(keys, n, depth, 2)
    total = np.zeros(len(keys))
    latest = (keys >> np.uint64(8 * depth)).astype(np.int64)
    byte = (keys & np.uint64(0xFF)).astype(np.int64)
    for bit in range(8):
        tree = (1 << bit) + (byte >> (8 - bit))
        mine = byte >> (7 - bit) & 1
        p = np.full(len(keys), 0.5)
        seen = np.zeros(len(keys), bool)

        def add(zeros, ones, own, w, p, seen):
            n_all = zeros + ones
            kt = (np.where(own == 1, ones, zeros) + 0.5) / (n_all + 1.0)
            p = np.where(n_all > 0, np.where(seen, w * kt + (1 - w) * p, kt), p)
            return p, seen | (n_all > 0)

        w = _weigh(levels, depth, 2, bit)
        at = np.arange(len(keys))
        for d in range(depth, 1, -1):
            node, zeros, ones, _, wt, _, _ = w[d]
            x = node[at]
            p, seen = add(zeros[x], ones[x], mine, wt[x], p, seen)
            if d > 2:
                at = levels[d].up[at]
        p, seen = add(counts[1, latest, tree, 0], counts[1, latest, tree, 1], mine, weight[1, latest, tree], p, seen)
        p, seen = add(counts[0, 0, tree, 0], counts[0, 0, tree, 1], mine, weight[0, 0, tree], p, seen)
        total += np.log10(p)
    return total


def _answer_grams(depth: int, top_b):
    def run(t: pa.Table) -> pa.Table:
        counts, weight = top_b.value
        lists = [_unpack(x) for x in t["keys"].to_pylist()]
        keys, n = _merge(lists, [_unplanes(x, np.int64) for x in t["counts"].to_pylist()])
        p = log10_probabilities(keys, n, depth, counts, weight).astype(np.float32)
        return pa.table({"chunk": t["chunk"], "kind": t["kind"], "shard": t["shard"],
                         "blob": pa.array([_planes(p[np.searchsorted(keys, x)]) for x in lists], pa.binary()),
                         "distinct": pa.array(np.zeros(len(lists), np.int64)), "total": pa.array(np.zeros(len(lists), np.int64))})
    return run


def _answer_words(t: pa.Table) -> pa.Table:
    lists = [_unpack(x) for x in t["keys"].to_pylist()]
    keys, n = _merge(lists, [_unplanes(x, np.int64) for x in t["counts"].to_pylist()])
    one = np.zeros(len(lists), np.int64)  # the shard's totals stand in its first row
    distinct, total = one.copy(), one
    distinct[0], total[0] = int((n > 0).sum()), int(n.sum())
    return pa.table({"chunk": t["chunk"], "kind": t["kind"], "shard": t["shard"],
                     "blob": pa.array([_planes(n[np.searchsorted(keys, x)]) for x in lists], pa.binary()),
                     "distinct": distinct, "total": total})


_ANSWER = "chunk long, kind int, shard int, blob binary, distinct long, total long"


def _score(depth: int, shards: int, n_all: int, n_distinct: int, n_ends: int):
    base_low = math.log10(n_all + ALPHA * (n_distinct + 1))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                raw = row["text"]
                text = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True) if len(raw) > 8 else b""
                offs = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
                data = np.frombuffer(text, np.uint8)
                col = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.tobytes()), pa.py_buffer(text))
                blobs = {(x["kind"], x["shard"]): x["blob"] for x in row["blobs"]}
                # the chunk's own lists again, in the order in which it sent them
                none = np.zeros(len(offs) - 1)
                keys = _distinct_grams(offs, data, depth, none)[0]
                of, p = _shard(keys, depth, shards), np.zeros(len(keys))
                for s in np.unique(of):
                    p[of == s] = _unplanes(blobs[0, int(s)], np.float32)
                look = pd.Index(keys)
                score = np.zeros(len(none))
                for lo, hi, g, ends in _grams(offs, data, depth):
                    score[lo:hi] = np.add.reduceat(p[look.get_indexer(g)], ends[:-1])
                words = [np.zeros(0, np.uint64)] + [np.unique(c.hash) for c in scan_words(col, SPACE_WORDS)]
                words = np.unique(np.concatenate(words))
                of, n = _word_shard(words, shards), np.zeros(len(words), np.int64)
                for s in np.unique(of):
                    n[of == s] = _unplanes(blobs[1, int(s)], np.int64)
                n_tok, n_known, base = (np.zeros(len(none)) for _ in range(3))
                for c in scan_words(col, SPACE_WORDS):
                    got = n[np.searchsorted(words, c.hash)]
                    for out, v in ((n_tok, np.ones(len(got))), (n_known, got > 0), (base, np.log10(got + ALPHA) - base_low)):
                        run_sum = np.concatenate([[0], np.cumsum(v)])
                        out[c.lo:c.hi] = run_sum[c.first[1:]] - run_sum[c.first[:-1]]
                base += math.log10(n_ends + ALPHA) - base_low
                bytes_ = np.diff(offs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["out"], pa.bool_()), pa.array((n_tok + 1).astype(np.int64)),
                     pa.array((n_known + (n_ends > 0)).astype(np.int64)), pa.array(np.full(len(none), n_all)), pa.array(base), pa.array(score),
                     pa.array(-score / math.log10(2) / np.maximum(1, bytes_))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
    return run


def ctw_scores(docs: DataFrame, depth: int = DEPTH, held_out=None) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-0.1 unigram words), score (log10 probability of the bytes
    and the end mark by context-tree weighting), bits_per_byte (code length).

    ``held_out`` is a boolean column; by default crc32(doc_id as text) mod 10 is 0.
    Grams are 64-bit exact; words are told apart by a 64-bit hash.

    Defined cases: a null text is an empty one: the end mark alone; a null
    doc_id hashes as the empty text; repeated rows count and are scored each;
    texts of any length are used whole; with no training text every bit is
    1/2; an empty table gives no rows; other columns are not looked at.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7: a gram is packed into 64 bits")
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = id_hash(10) == 0 if held_out is None else held_out
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    text_batches(spark, 10_000)  # a chunk lies inside a batch
    chunks = saved(d.mapInArrow(_cut_chunks(depth, shards), _CHUNKS), "chunks")
    lists = chunks.select("chunk", F.inline("lists"))
    grams, words = lists.where("kind = 0"), lists.where("kind = 1")
    sums = (grams.groupBy("shard").applyInArrow(_top_sums(depth), "latest long, tree long, zeros long, ones long, lpw double")
            .groupBy("latest", "tree").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("lpw").alias("lpw")))
    counts, weight, _ = _top_tables(sums.toPandas())  # at most 256 x 255 rows
    top = spark.sparkContext.broadcast((counts, weight))
    answers = saved(grams.groupBy("shard").applyInArrow(_answer_grams(depth, top), _ANSWER)
                    .unionByName(words.groupBy("shard").applyInArrow(_answer_words, _ANSWER)), "answers")
    n_distinct, n_words = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    ends = chunks.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    blobs = answers.groupBy("chunk").agg(F.collect_list(F.struct("kind", "shard", "blob")).alias("blobs"))
    asked = chunks.select("chunk", "ids", "out", "sizes", "text").join(blobs, "chunk")
    return asked.mapInArrow(
        _score(depth, shards, n_words + ends, n_distinct + (ends > 0), ends),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents"))


