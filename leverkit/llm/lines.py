"""Operator 1: line dedup by a segment-partition edit join.

Lines within ``tau`` edits of each other are linked; each class of linked
lines keeps its first occurrence.  Method:

* a line of length l is cut into tau + 1 even segments.  A line within tau
  edits of it must contain one of them unchanged, at a place that the length
  difference and the segment's number narrow to a few positions;
* every distinct line is indexed under (l, segment number, segment) and probes
  the indexes of the lengths l - tau .. l with those substrings only;
* the join on the key keeps a pair if the parities of its character counts
  differ in 2 * tau of 64 classes at most (an edit changes two at most);
* first the lines of a key meet only its leader, the line with the most
  copies; then the pairs of a key that still lie in different components meet;
* the texts of the remaining pairs are compared with a banded bit-parallel
  edit distance;
* connected components over distinct lines give the classes.

Exact copies are one distinct line, so a line that a third of all documents
share is indexed once, and a line of which there are very many variants costs
about their number, not its square.  A segment that very many different lines
share makes a skewed join key, which the adaptive join splits.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import BROADCAST_BYTES, _power_tables, mix, row_chunks, saved, table, text_batches, text_buffers, text_key
from leverkit.llm.components import components

TAU = 2
#: characters of a line that takes part in the edit join; shorter ones of
#: MIN_EXACT characters or more (without the spaces at their ends) meet their exact copies only
MIN_CHARS = 20
MIN_EXACT = 3
SLOTS = 1 << 21
#: lines that occur more often than one in so many occurrences are told of by
#: broadcast; there are fewer of them than this
HEAVY = 4096
#: lines per file of an intermediate table
LINES_A_FILE = 50_000

_rng = np.random.default_rng(7)
_POINT = _rng.integers(1, 2**63, 0x110000, dtype=np.uint64)
_PARITY = np.uint64(1) << (_POINT >> np.uint64(40)) % np.uint64(64)


def edit_at_most(a: str, b: str, tau: int) -> bool:
    """Whether the Levenshtein distance is at most tau: bit-parallel columns
    over a band of 2 tau + 1 diagonals, after common ends are cut off."""
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    a, b = _cut_ends(a, b)
    if len(a) < len(b):
        a, b = b, a
    m, n, k = len(a), len(b), tau
    if m <= k:
        return True  # at most max(m, n) edits
    if n == 0:
        return m <= k
    match: dict[str, int] = {}
    for i, ch in enumerate(a):
        match[ch] = match.get(ch, 0) | 1 << i
    width = 2 * k + 1
    full = (1 << width) - 1
    vp, vn, dist = ((1 << k + 1) - 1) << k, 0, k
    for j in range(1, n + 1):
        # bit x of the band stands for row j - k + x
        low = j - k - 1
        bits = match.get(b[j - 1], 0)
        pm = (bits >> low if low >= 0 else bits << -low) & full
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + k <= m:  # down the lowest diagonal
            dist += not d0 >> 2 * k & 1
            # each later step keeps or raises it; the last row can win back k at most
            if dist > 2 * k:
                return False
        else:  # along the last row
            x = m - j + k
            dist += (hp >> x & 1) - (hn >> x & 1)
        vp = (hn | ~(d0 >> 1 | hp)) & full
        vn = d0 >> 1 & hp
    return dist <= k


def _cut_ends(a: str, b: str) -> tuple[str, str]:
    i, step = 0, min(len(a), len(b))
    while step:  # common start, by halving blocks
        while a[i:i + step] == b[i:i + step] and i + step <= min(len(a), len(b)):
            i += step
        step //= 2
    a, b = a[i:], b[i:]
    i, step = 0, min(len(a), len(b))
    while step:
        while i + step <= min(len(a), len(b)) and a[len(a) - i - step:len(a) - i] == b[len(b) - i - step:len(b) - i]:
            i += step
        step //= 2
    return a[:len(a) - i], b[:len(b) - i]


def _segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of the given lengths."""
    base, more = length // (tau + 1), length % (tau + 1)
    short = tau + 1 - more
    return i * base + np.maximum(0, i - short), base + (i >= short)


def segment_keys(lines: list[str], tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index keys, probe keys, probe validity, parity signature) of lines of
    more than tau characters; one row a line.  A line also probes its own index
    keys; these are not repeated among the probe keys."""
    size = np.array([len(x) for x in lines], np.int64)
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    up, down = _power_tables(len(cp) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_POINT[cp] * up[:len(cp)], out=run[1:])

        def key(start, seg, length, i):
            h = (run[start + seg] - run[start]) * down[start]
            return mix(h + mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(i)))

        index, probe, valid = [], [], []
        for i in range(tau + 1):
            start, seg = _segment(size, i, tau)
            index.append(key(at + start, seg, size, i))
        for diff in range(tau + 1):
            length = size - diff
            for i in range(tau + 1):
                start, seg = _segment(length, i, tau)
                # the positions that a line with tau edits leaves possible
                lo = max(-i, diff - (tau - i))
                hi = min(i, diff + (tau - i))
                for move in range(lo, hi + 1):
                    if diff == move == 0:
                        continue
                    p = start + move
                    ok = (p >= 0) & (p + seg <= size)
                    probe.append(key(at + np.where(ok, p, 0), seg, length, i))
                    valid.append(ok)
    sig = np.bitwise_xor.reduceat(_PARITY[cp], at)
    return np.stack(index, 1), np.stack(probe, 1), np.stack(valid, 1), sig


def _lists(keys: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    n = np.full(len(keys), keys.shape[1]) if ok is None else ok.sum(1)
    flat = keys.ravel() if ok is None else keys[ok]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)),
                                    pa.array(flat.view(np.int64)))


def _line_key(b: bytes) -> bytes:
    return hashlib.md5(b).digest()


def _text_lines(col):
    """Lists of the lines (bytes) of runs of rows of a text column."""
    offs, data = text_buffers(col)
    for lo, hi in row_chunks(offs):
        yield [x for i in range(lo, hi) for x in data[offs[i]:offs[i + 1]].tobytes().split(b"\n")]


def _keys(tau: int, min_chars: int):
    def run(batches):
        seen = set()  # lines that this task has sent; at most its lines
        for b in batches:
            for lines in _text_lines(b.column("text")):
                keys, strs, copies = [], [], {}
                for x in lines:
                    if len(x) < min_chars or len(s := x.decode("utf-8", "replace")) < min_chars or not s.strip():
                        continue
                    k = _line_key(x)
                    copies[k] = copies.get(k, 0) + 1
                    if k not in seen:
                        seen.add(k)
                        keys.append(k)
                        strs.append(s)
                if strs:
                    index, probe, ok, sig = segment_keys(strs, tau)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array([copies.pop(k) for k in keys], pa.int64()),
                         pa.array(sig.view(np.int64)), _lists(index), _lists(probe, ok)],
                        ["line", "copies", "sig", "index", "probe"])
                if copies:  # lines that this task has sent before
                    none = pa.array([None] * len(copies), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(copies), pa.binary()), pa.array(list(copies.values()), pa.int64()),
                         pa.array([None] * len(copies), pa.int64()), none, none],
                        ["line", "copies", "sig", "index", "probe"])
    return run


def _texts(slots_b):
    def run(batches):
        seen = set()
        for b in batches:
            slots = slots_b.value
            for lines in _text_lines(b.column("text")):
                out = []
                for x in lines:
                    k = _line_key(x)
                    if slots[int.from_bytes(k[:4], "big") % len(slots)] and k not in seen:
                        seen.add(k)
                        out.append((k, x.decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()),
                                                  pa.array([o[1] for o in out], pa.string())], ["line", "s"])
    return run


def _near(tau: int):
    def run(batches):
        for b in batches:
            s, t = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            keep = pa.array([edit_at_most(x, y, tau) for x, y in zip(s, t, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)
    return run


def _verified(spark, d: DataFrame, keys: DataFrame, pairs: DataFrame, tau: int, parts: int) -> DataFrame:
    """The pairs (a, b) whose lines are within tau edits."""
    wanted = saved(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
                   .join(keys.select("id", "line"), "id"), "wanted-lines", parts)
    slot = F.conv(F.substring(F.hex("line"), 1, 8), 16, 10).cast("long") % SLOTS
    slots = np.zeros(SLOTS, np.uint8)
    slots[wanted.select(slot.cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()] = 1
    slots = spark.sparkContext.broadcast(slots)
    texts = saved(d.select("text").mapInArrow(_texts(slots), "line binary, s string").dropDuplicates(["line"])
                  .join(wanted, "line").select("id", "s"), "line-texts", parts)
    return (pairs.join(texts.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(_near(tau), "a long, b long"))


def line_classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """One row a line: doc_id, key (content key of the document's text),
    line_no (from 0), first_doc, first_key, first_line (the first occurrence of
    its class, in order of doc_id, content key and line), kept.

    Lines are split at line feeds.  Lines of fewer than ``min_chars``
    characters are linked with their exact copies only, and those of fewer than
    ``min_exact`` (trimmed) and blank ones with nothing: they are kept.

    Defined cases: a null or empty text has no lines; a null doc_id sorts
    first; rows alike in id and text count as one document, so both keep the
    same lines; lines of any length take part whole; an empty table gives no
    rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_batches(spark)
    # the content key is named before the lines are: beside them it would be taken once a line
    occ = (d.where(F.length("text") > 0).withColumn("key", text_key())
           .select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "s"))
           .select("doc_id", "key", "line_no", F.unhex(F.md5("s")).alias("line"),
                   ((F.length("s") >= min_chars) & (F.length(F.trim("s")) > 0) | (F.length(F.trim("s")) >= min_exact)).alias("long")))
    occ = saved(occ, "occurrences")
    n_lines = occ.count()
    parts = 1 + n_lines // LINES_A_FILE
    keys = d.select("text").mapInArrow(_keys(tau, min_chars), "line binary, copies long, sig long, index array<long>, probe array<long>")
    keys = saved(keys.groupBy("line").agg(F.sum("copies").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("sig", "index", "probe")])
                 .withColumn("id", F.monotonically_increasing_id()), "line-keys", parts)
    near = F.bit_count(F.col("sig").bitwiseXOR(F.col("sig2"))) <= 2 * tau

    def pair(x):
        return x.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()

    # the leader of each key, and the other lines that have or probe it
    own = keys.select("id", "sig", "copies", F.explode("index").alias("k"))
    leaders = own.groupBy("k").agg(F.min_by(F.struct("id", "sig"), F.struct(-F.col("copies"), "id")).alias("l"))
    every = keys.select("id", "sig", F.lit(True).alias("own"), F.explode("index").alias("k")).unionByName(
        keys.select("id", "sig", F.lit(False).alias("own"), F.explode("probe").alias("k")))
    met = (every.join(leaders, "k").where("id <> l.id")
           .select("k", "id", "sig", "own", F.col("l.id").alias("id2"), F.col("l.sig").alias("sig2")))
    met = saved(met, "line-keys-met", parts)
    # first each line meets one leader, that of most of its keys
    one = (met.where(near).groupBy("id", "id2").agg(F.count("*").alias("keys"))
           .groupBy("id").agg(F.max_by("id2", F.struct("keys", "id2")).alias("id2")))
    pairs = saved(pair(one), "line-pairs", parts)
    links = saved(_verified(spark, d, keys, pairs, tau, parts), "line-links", parts)
    label = saved(components(links, parts=parts), "line-labels", parts).withColumnRenamed("node", "id")
    # then what is still apart
    met = met.join(label, "id", "left").join(label.select(F.col("id").alias("id2"), F.col("label").alias("label2")), "id2", "left")
    met = saved(met.withColumns({"label": F.coalesce("label", "id"), "label2": F.coalesce("label2", "id2")}), "line-keys-apart", parts)
    apart = met.groupBy("k").agg(F.min(F.least("label", "label2")).alias("x"), F.max(F.greatest("label", "label2")).alias("y")).where("x < y").select("k")
    rest = saved(met.join(apart, "k"), "line-rest", parts)
    other = rest.where("own").select(F.col("k").alias("k2"), F.col("id").alias("id3"), F.col("sig").alias("sig3"), F.col("label").alias("label3"))
    # two lines that both have the key meet once
    among = (rest.join(other, (F.col("k") == F.col("k2")) & (F.col("label") != F.col("label3"))
                       & (~F.col("own") | (F.col("id") < F.col("id3")))
                       & (F.bit_count(F.col("sig").bitwiseXOR(F.col("sig3"))) <= 2 * tau))
             .select("id", F.col("id3").alias("id2")))
    more = pair(rest.where("label <> label2").where(near).select("id", "id2").unionByName(among)).join(pairs, ["a", "b"], "left_anti")
    more = saved(more, "line-pairs", parts)
    if more.take(1):
        links = links.unionByName(saved(_verified(spark, d, keys, more, tau, parts), "line-links", parts))
    labels = saved(components(links, parts=parts), "line-labels", parts)
    first = F.min(F.struct("doc_id", "key", "line_no"))
    # the class of a line that has links, by the line
    named = saved(labels.join(keys.select(F.col("id").alias("node"), "line"), "node").select("line", "label"), "line-classes", parts)
    firsts = saved(occ.where("long").groupBy("line").agg(first.alias("f"), F.count("*").alias("n")), "line-firsts", parts)
    linked = firsts.join(named, "line")
    ahead = linked.groupBy("label").agg(F.min("f").alias("g"))
    linked = linked.join(ahead, "label").select("line", "g")
    # a line that occurs once and is linked with nothing is its own first occurrence
    firsts = (firsts.join(linked, "line", "left").where((F.col("n") > 1) | F.col("g").isNotNull())
              .select("line", F.coalesce("g", "f").alias("f"), "n"))
    firsts = saved(firsts, "line-classes-firsts", parts)
    # fewer than HEAVY lines can each have more than 1 / HEAVY of all occurrences:
    # these are broadcast, so that their occurrences stay where they are
    heavy = F.col("n") > n_lines // HEAVY
    met = occ.join(F.broadcast(firsts.where(heavy).select("line", F.col("f").alias("h"))), "line", "left")
    apart = F.unhex(F.md5(F.concat_ws(",", F.hex("key"), F.col("doc_id").cast("string"), F.col("line_no").cast("string"))))
    met = met.withColumn("at", F.when(F.col("long") & F.col("h").isNull(), F.col("line")).otherwise(apart))
    met = met.join(firsts.where(~heavy).select(F.col("line").alias("at"), "f"), "at", "left")
    me = F.struct("doc_id", "key", "line_no")
    return (met.withColumn("f", F.coalesce(F.when(F.col("long"), F.coalesce("h", "f")), me))
            .select("doc_id", "key", "line_no", F.col("f.doc_id").alias("first_doc"), F.col("f.key").alias("first_key"),
                    F.col("f.line_no").alias("first_line"), F.col("f").eqNullSafe(me).alias("kept")))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """The documents, all their columns, with later lines of each class cut
    from ``text``.  A document that loses all its lines is dropped; one that
    had none stays.  ``n_chars``, where there is one, is the new length."""
    cut = saved(line_classes(docs, tau, min_chars, min_exact).where("not kept").groupBy("doc_id", "key")
                .agg(F.collect_set("line_no").alias("__cut")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__cut"), "cut")
    size = cut.agg(F.sum(F.size("__cut") * F.lit(4) + F.lit(96).cast("long"))).first()[0] or 0
    cut = F.broadcast(cut) if size <= BROADCAST_BYTES else cut
    d = docs.withColumn("__k", text_key())
    d = d.join(cut, d["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__cut", i)), "\n")
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(left)
    d = d.withColumn("text", text).where(F.col("__cut").isNull() | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return d.select(*docs.columns)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a line of every document: its class's first occurrence and
    whether it stays."""
    return line_classes(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "first_doc", "first_line", "kept")
