"""Operator 5: n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word shingles (64-bit hashes).  The
global order of all shingles is cut into fragments (ranges of the hash); inside
a fragment rarer shingles come first.  Work goes in this order:

1. equal sets become one class, so exact copies are never paired;
2. a class of n shingles needs only the first n - ceil(t n) + 1 shingles of the
   global order (its prefix) to meet every class it may link with.  These lie
   in fragment 0 for all but few classes, so only those shingles are counted
   and moved (a class whose fragment 0 is too small moves all of its own);
   Of the classes that are left all shingles are then counted: a class of
   which more than a tenth are in no other class left has no link;
3. classes that share a prefix shingle become candidates.  First each bucket is
   compared with a leader only, the class with the fewest shingles of its own
   (at most one pair a class); then, in a few rounds, classes that stand next
   to each other in a bucket ordered by the least hashes of their prefixes
   (for chains of copies of copies, which no leader resembles).  Classes
   connected by now need no further comparison.  Then the classes that may
   still miss a link take new prefixes, the rarest shingles of their whole
   sets, and all pairs of a bucket that lie in different
   components are compared, as far as their sizes, the shingle's places and
   the shingles that only they have leave a link possible, and their parity
   sketches: a class has one bit a slot of the hash space, the parity of its
   shingles there, and two sets differ in at least as many shingles as their
   sketches in bits.  A bucket of more than CROWD classes is not paired by its
   shingle, which nearly all of a large group of near copies have, but by what
   sets its classes apart from one of them, the pivot (see ``_crowd_pairs``).
   So a large group of near copies costs about its size, and no link between
   components is lost;
4. a pair's overlap is counted fragment by fragment and summed.  Fragment 0 is
   counted first and drops pairs that the rest could not save.

Classes carry a 64-bit digest of their set: two different sets among N collide
with a probability of about N^2 / 2^65.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import SPACE_WORDS, saved, scan_words, shingle_hashes, small_or_plain, text_batches, table, text_key
from leverkit.llm.components import components

SHINGLE = 3
#: links: DEN * intersection >= NUM * union
NUM, DEN = 90, 100
#: number of equal fragments above fragment 0
TAIL_FRAGMENTS = 5
#: rounds of neighbours between the leader round and the pairs that are left, and
#: how many rows before a class in a bucket's order it is compared with in each
NEIGHBOUR_ROUNDS = 2
NEIGHBOURS = 3
#: slots of the filter of wanted classes that is broadcast, one byte each
SLOTS = 1 << 21
ALONE_ROUNDS = 3
#: classes of a bucket whose pairs are listed by the bucket's shingle
CROWD = 32
#: longs of a parity sketch
SKETCH = 8
#: documents per file of an intermediate table
ROWS_A_FILE = 5_000
#: bytes assumed for a row of a few ids when its broadcast is checked
ROW_BYTES = 64

def _bounds(num: int, den: int) -> np.ndarray:
    """Where the fragments above fragment 0 begin.  Fragment 0 has 15/8 of the
    share of shingles that a prefix takes (3/16 of the hash space at 90/100),
    less than half of the hash space."""
    head = min(15 * (den - num) / (8 * den), 31 / 64)
    return np.array([int((head + (1 - head) * i / TAIL_FRAGMENTS) * 2**64) for i in range(TAIL_FRAGMENTS)], dtype=np.uint64)


def _sets(col, k: int, word_class):
    """(row, sorted distinct shingle hashes) of every row of a text column."""
    for c in scan_words(col, word_class):
        h = shingle_hashes(c.hash, k)
        for i in range(c.hi - c.lo):
            a, z = int(c.first[i]), int(c.first[i + 1])
            if z - a >= k:
                yield c.lo + i, np.unique(h[a:z - k + 1])
            elif z > a:
                yield c.lo + i, shingle_hashes(c.hash[a:z], z - a)
            else:
                yield c.lo + i, np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each slot of the hash space."""
    odd = np.bincount((s // np.uint64(2**64 // (64 * SKETCH))).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix_size(n: int, num: int, den: int) -> int:
    return n + num * n // -den + 1


def _classes(k: int, num: int, den: int, word_class):
    bounds = _bounds(num, den)

    def run(batches):
        seen = set()  # classes that this task has sent: at most one a row
        for b in batches:
            cids, ns, toks, heads = [], [], [], []
            for _, s in _sets(b.column("text"), k, word_class):
                cid = _digest(s)
                head = int(np.searchsorted(s, bounds[0]))
                cids.append(cid)
                ns.append(len(s))
                heads.append(head)
                if cid in seen or not len(s):
                    toks.append(None)
                    continue
                seen.add(cid)
                toks.append((s[:head] if head >= _prefix_size(len(s), num, den) else s).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(cids, pa.int64()), pa.array(ns, pa.int32()),
                 pa.array(heads, pa.int32()), pa.array(toks, pa.list_(pa.int64()))],
                ["doc_id", "key", "cid", "n", "head", "toks"])
    return run


def _segments(k: int, slots_b, word_class, bounds: np.ndarray):
    """Fragments of the wanted classes (a superset: the slot table has false positives)."""
    def run(batches):
        seen = set()
        for b in batches:
            slots, out = slots_b.value, []
            for _, s in _sets(b.column("text"), k, word_class):
                if not len(s):
                    continue
                cid = _digest(s)
                if cid in seen or not slots[cid % len(slots)]:
                    continue
                seen.add(cid)
                cut = [0, *np.searchsorted(s, bounds).tolist(), len(s)]
                out += [(cid, f, s[cut[f]:cut[f + 1]].view(np.int64), None if f else _sketch(s)) for f in range(len(cut) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                ["cid", "f", "toks", "sketch"])
    return run


def _slots(df: DataFrame, col: str) -> np.ndarray:
    out = np.zeros(SLOTS, np.uint8)
    out[df.select(F.pmod(F.col(col), F.lit(SLOTS)).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()] = 1
    return out


def _prefixes(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(tok, cid, n, pos): prefix shingles that some other class shares; pos is
    the shingle's place in its class by the global order."""
    sent = rows.where("toks is not null")
    stats = sent.groupBy("cid").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.first(F.size("toks")).alias("m"))
    t = sent.select("cid", F.explode("toks").alias("tok"))
    counts = t.groupBy("tok").agg(F.count("*").alias("cnt")).where("cnt > 1")
    # unsigned comparison with the bound of fragment 0, which is below 2^63
    tail = (F.col("tok") < 0) | (F.col("tok") >= F.lit(int(_bounds(num, den)[0])))
    shared = (t.join(counts.hint("shuffle_hash"), "tok")
              .groupBy("cid").agg(F.collect_set(F.struct(tail.alias("tail"), "cnt", "tok")).alias("s")))
    d = shared.join(stats, "cid").withColumn("s", F.array_sort("s"))
    in_head = F.size(F.filter("s", lambda x: ~x["tail"]))
    d = d.withColumn("h", in_head).withColumn("own", F.col("m") - F.size("s"))
    own_head = F.col("head") - F.col("h")
    pos = F.transform("s", lambda x, i: F.struct(
        x["tok"].alias("tok"), (i + F.when(x["tail"], F.col("own")).otherwise(own_head)).alias("pos")))
    need = F.expr(f"n - ((n * {num} + {den - 1}) div {den}) + 1")
    return d.select("cid", "n", F.inline(F.filter(pos, lambda x: x["pos"] < need)))


def _left_prefixes(now: DataFrame, segs: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """The prefixes of the classes of ``now`` taken anew, from whole sets and by
    rarity among these classes.  What no class of another component has comes
    first: it is in no link that is still missing (``own`` counts it)."""
    ids = now.select("cid", "n", "label").distinct()
    t = segs.join(ids, "cid").select("cid", "n", "label", F.explode("toks").alias("tok"))
    counts = (t.groupBy("tok").agg(F.count("*").alias("cnt"), F.min("label").alias("x"), F.max("label").alias("y"))
              .where("x < y").select("tok", "cnt"))
    shared = (t.join(counts.hint("shuffle_hash"), "tok")
              .groupBy("cid", "n", "label").agg(F.array_sort(F.collect_list(F.struct("cnt", "tok"))).alias("s")))
    shared = shared.withColumn("own", F.col("n") - F.size("s")).where(f"{den} * (n - own) >= {num} * n")
    pos = F.transform("s", lambda x, i: F.struct(x["tok"].alias("tok"), (i + F.col("own")).alias("pos")))
    need = F.expr(f"n - ((n * {num} + {den - 1}) div {den}) + 1")
    rows = saved(shared.select("cid", "n", "label", "own", F.inline(F.filter(pos, lambda x: x["pos"] < need))), "rarest", parts)
    split = rows.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("tok")
    return rows.join(split, "tok")


def _comparable(num: int, den: int):
    """The length bound on (n, n2)."""
    return F.expr(f"{den} * least(n, n2) >= {num} * greatest(n, n2)")


def _least_overlap(num: int, den: int) -> str:
    return f"{num + den} * c >= {num} * (n + n2)"


def _may_link(num: int, den: int):
    """Whether the sketches x and y leave a link of sets of n and n2 shingles possible."""
    bits = " + ".join(f"bit_count(x{i} ^ y{i})" for i in range(SKETCH))
    return F.expr(f"{num + den} * ({bits}) <= {den - num} * (n + n2)")


def _verify(pairs: DataFrame, segs: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Pairs (a, b, n, n2) whose overlap, summed over the fragments, links them."""
    def side(f, name):
        return segs.where(f).select(F.col("cid").alias(name), "f", F.col("toks").alias(f"t{name}"))

    head = (pairs.join(side("f = 0", "a").drop("f"), "a").join(side("f = 0", "b").drop("f"), "b")
            .withColumn("c0", F.size(F.array_intersect("ta", "tb")))
            .withColumn("c", F.col("c0") + F.least(F.col("n") - F.size("ta"), F.col("n2") - F.size("tb")))
            .where(_least_overlap(num, den)).select("a", "b", "n", "n2", "c0"))
    head = saved(head, "partial", parts)
    rest = (head.join(side("f > 0", "a"), "a").join(side("f > 0", "b"), ["b", "f"])
            .select("a", "b", "n", "n2", F.size(F.array_intersect("ta", "tb")).cast("long").alias("c0"))
            .unionByName(head.withColumn("c0", F.col("c0").cast("long")))
            .groupBy("a", "b", "n", "n2").agg(F.sum("c0").alias("c")))
    return rest.where(_least_overlap(num, den)).select("a", "b")


def _ordered_pairs(df: DataFrame) -> DataFrame:
    """(a, b, n, n2) with a < b, each pair once."""
    swap = F.col("cid") > F.col("cid2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return df.select(pick("cid", "cid2").alias("a"), pick("cid2", "cid").alias("b"),
                     pick("n", "n2").alias("n"), pick("n2", "n").alias("n2")).distinct()


_SIDE = ("cid", "n", "pos", "own", "label")


def _behind(batches):
    """Over rows sorted by bucket and signature: each row with the few before
    it in its bucket.  Pairs across a task's border are not needed."""
    last = None
    for b in batches:
        t = np.array(b.column("tok"), np.int64)
        v = np.column_stack([np.array(b.column(c), np.int64) for c in _SIDE]) if len(t) else np.zeros((0, len(_SIDE)), np.int64)
        if last is not None:
            t, v = np.concatenate([last[0], t]), np.concatenate([last[1], v])
        new, out = len(t) - b.num_rows, []
        for k in range(1, NEIGHBOURS + 1):
            at = np.arange(max(new, k), len(t))
            at = at[t[at] == t[at - k]]
            out.append(np.concatenate([v[at], v[at - k]], 1))
        out = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(2 * len(_SIDE))], [*_SIDE, *(f"{c}2" for c in _SIDE)])
        last = t[-NEIGHBOURS:], v[-NEIGHBOURS:]


def _neighbours(now: DataFrame, turn: int, parts: int) -> DataFrame:
    """Pairs of classes that stand next to each other in a bucket when it is
    ordered by the least hashes of their prefixes: alike sets begin alike."""
    sig = now.groupBy("cid").agg(F.slice(F.array_sort(F.collect_set(F.xxhash64("tok", F.lit(turn)))), 1, 4).alias("sig"))
    order = ["tok", "sig", "cid"]
    pairs = (now.join(sig, "cid").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("tok", *_SIDE)
             .mapInArrow(_behind, ", ".join(f"{c} long" for c in (*_SIDE, *(f"{c}2" for c in _SIDE)))))
    return pairs.where("label <> label2")


def _differences(crowds: DataFrame, segs: DataFrame, parts: int) -> DataFrame:
    """(p, np, cid, n, d, f): what sets the classes of each bucket apart from
    the bucket's pivot p, the shingles that only one of the two has, by
    fragments.  A class and a pivot meet once, however many buckets they share."""
    pivots = crowds.groupBy("tok").agg(F.min_by(F.struct("cid", "n"), F.struct("own", "cid")).alias("l"))
    near = (crowds.join(small_or_plain(saved(pivots, "pivots", parts), ROW_BYTES), "tok").where("cid <> l.cid")
            .select(F.col("l.cid").alias("p"), F.col("l.n").alias("np"), "cid", "n").distinct())
    mine = near.join(segs.select("cid", "f", F.col("toks").alias("t")), "cid")
    its = segs.select(F.col("cid").alias("p"), "f", F.col("toks").alias("tp"))
    return saved(mine.join(its, ["p", "f"]).select("p", "np", "cid", "n", "f", F.concat(
        F.array_except("t", "tp"), F.array_except("tp", "t")).alias("d")), "differences", parts)


def _crowd_pairs(diff: DataFrame, apart: DataFrame, now: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Candidates (cid, n, cid2, n2) of the classes that were set apart from the
    same pivot p and are not in one component.

    Let D be a class's difference from p and e its size.  Two classes of n and
    n2 shingles differ in e + e2 - 2 * |D & D2| shingles and link if that is at
    most T = (den - num) / (num + den) * (n + n2), so their differences share
    k >= (e + e2 - T) / 2.  If that is not positive, both classes link with p
    (e <= T - e2 and n2 <= np + e2), whose links are known by now.  Else the
    differences meet in their prefixes by rarity: what nearly all classes have
    or lack as against p comes last.  A class in p's component needs partners
    that do not link with p, which gives k > num / (num + den) * e at least.
    """
    t = F.lit((den - num) / (num + den))
    some = apart.where(F.col("e") > 0).join(now.select("cid", "label").distinct(), "cid")
    pivot_label = now.select(F.col("cid").alias("p"), F.col("label").alias("lp")).distinct()
    most = (den - num) / num  # T is at most this times n, by the sizes that can link
    k = F.when(F.col("label") == F.col("lp"), F.floor(F.lit(num / (num + den)) * F.col("e") - 1e-6) + 1).otherwise(
        F.ceil((F.col("e") + F.greatest(F.lit(0.0), F.col("e") - most * F.col("n")) - most * F.col("n")) / 2 - 1e-6))
    some = some.join(pivot_label, "p").select("p", "cid", "n", "e", "label", F.greatest(F.lit(1), k).cast("int").alias("k"))
    toks = diff.select("p", "cid", F.explode("d").alias("tok"))
    counts = saved(toks.groupBy("p", "tok").agg(F.count("*").alias("cnt")).where("cnt > 1"), "differing", parts)
    shared = (toks.join(small_or_plain(counts, ROW_BYTES), ["p", "tok"])
              .groupBy("p", "cid").agg(F.array_sort(F.collect_list(F.struct("cnt", "tok"))).alias("s")))
    pos = F.transform("s", lambda x, i: F.struct(x["tok"].alias("tok"), (i + F.col("e") - F.size("s")).cast("int").alias("pos")))
    sketches = [f"x{i}" for i in range(SKETCH)]
    rows = (shared.join(some, ["p", "cid"])
            .select("p", "cid", "n", "e", "label", F.inline(F.filter(pos, lambda x: x["pos"] <= F.col("e") - F.col("k"))))
            .join(now.select("cid", *sketches).distinct(), "cid"))
    rows = saved(rows, "apart", parts)
    other = small_or_plain(rows.select("p", "tok", *[F.col(c).alias(f"{c}2") for c in ("cid", "n", "e", "label", "pos")],
                                       *[F.col(f"x{i}").alias(f"y{i}") for i in range(SKETCH)]), 4 * ROW_BYTES)
    enough = 2 * F.least(F.expr("e - pos"), F.expr("e2 - pos2")) >= F.expr("e + e2") - t * F.expr("n + n2") - 1e-6
    return (rows.withColumnsRenamed({"p": "p_", "tok": "tok_"})
            .join(other, F.expr("p = p_ and tok = tok_ and label < label2") & _comparable(num, den) & enough & _may_link(num, den))
            .select("cid", "n", "cid2", "n2"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN,
                       word_class: np.ndarray = SPACE_WORDS, neighbour_rounds: int = NEIGHBOUR_ROUNDS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, its own included), component (a label; null
    without shingles) and key (content key of the text).

    Defined cases: null, empty and word-free texts have no shingles and link
    with nothing; a text of fewer words than a shingle is one shingle of all of
    them; repeated rows are copies of one another and each get a row; a null
    doc_id takes part and counts only if no other id is in its component;
    texts of any length are used whole; an empty table gives no rows; further
    columns are not looked at.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    text_batches(spark)
    rows = saved(d.mapInArrow(_classes(shingle, num, den, word_class),
                              "doc_id long, key binary, cid long, n int, head int, toks array<long>"), "classes")
    parts = 1 + rows.count() // ROWS_A_FILE
    pre = saved(_prefixes(rows, num, den), "prefix", parts)
    # buckets with one class only are gone: every shingle here was moved twice,
    # but perhaps by two tasks for the same class
    some = pre.groupBy("tok").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("tok")
    pre = saved(pre.join(some, "tok"), "buckets", parts)
    slots = spark.sparkContext.broadcast(_slots(pre, "cid"))
    segs = saved(d.select("text").mapInArrow(_segments(shingle, slots, word_class, _bounds(num, den)),
                                             "cid long, f int, toks array<long>, sketch array<long>").dropDuplicates(["cid", "f"]), "segments", parts)
    # now that few classes are left, count all their shingles: one that no other
    # class left has cannot be shared, so the overlap is bounded by the rest
    # (again, as what one count drops makes more shingles single)
    left = segs
    for _ in range(ALONE_ROUNDS):
        alone = (left.select("cid", F.explode("toks").alias("tok")).groupBy("tok")
                 .agg(F.count("*").alias("c"), F.min("cid").alias("cid")).where("c = 1").groupBy("cid").agg(F.count("*").cast("int").alias("alone")))
        pre = (pre.drop("own").join(saved(alone, "alone", parts), "cid", "left").withColumn("own", F.coalesce("alone", F.lit(0))).drop("alone")
               .where(f"{den} * (n - own) >= {num} * n"))
        some = pre.groupBy("tok").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("tok")
        pre = saved(pre.join(some, "tok"), "buckets", parts)
        left = segs.join(pre.select("cid").distinct(), "cid", "left_semi")
    links, tested, labels = None, None, None
    bound = F.expr(f"{num + den} * least(n - pos, n2 - pos2, n - own, n2 - own2) >= {num} * (n + n2)")

    for turn in range(neighbour_rounds + 2):
        now = pre.withColumn("label", F.col("cid"))
        if labels is not None:
            now = (pre.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
                   .withColumn("label", F.coalesce("label", "cid")))
            split = now.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("tok")
            now = now.join(split, "tok")
        if turn == 0:
            band = F.floor(F.log("n") / math.log(den / num)).alias("band")
            lead = (now.groupBy("tok", band).agg(F.min_by(F.struct(*_SIDE), F.struct("own", "cid")).alias("l"))
                    .select("tok", "band", *[F.col(f"l.{c}").alias(f"{c}2") for c in _SIDE]))
            cand = now.withColumn("band", band).join(lead, ["tok", "band"]).where("label <> label2").where(_comparable(num, den)).where(bound)
            # each class meets one leader, that of most of its buckets: at most a pair a class
            cand = (cand.groupBy("cid", "n", "cid2", "n2").agg(F.count("*").alias("met"))
                    .groupBy("cid", "n").agg(F.max_by(F.struct("cid2", "n2"), F.struct("met", "cid2")).alias("l"))
                    .select("cid", "n", "l.cid2", "l.n2"))
        elif turn <= neighbour_rounds:
            cand = _neighbours(now, turn, parts).where(_comparable(num, den)).where(bound)
            cand = cand.select("cid", F.col("n").cast("int"), "cid2", F.col("n2").cast("int"))
        else:
            if not now.take(1):
                break
            sketches = segs.where("f = 0").select("cid", *[F.col("sketch")[i].alias(f"x{i}") for i in range(SKETCH)])
            now = saved(_left_prefixes(now, segs, num, den, parts).join(sketches, "cid"), "left", parts)
            size = now.groupBy("tok").agg(F.count("*").alias("size")).where(F.col("size") > CROWD)
            size = saved(size, "crowds", parts)
            crowded = bool(size.take(1))
            if crowded:
                diff = _differences(now.join(small_or_plain(size, ROW_BYTES), "tok"), segs, parts)
                apart = saved(diff.groupBy("p", "np", "cid", "n").agg(F.sum(F.size("d")).alias("e")), "distances", parts)
                # these distances are exact, so the pairs need no further comparison
                got = (apart.where(F.expr(f"{num + den} * e <= {den - num} * (n + np)")).select(F.col("p").alias("a"), F.col("cid").alias("b"))
                       .join(now.select(F.col("cid").alias("a"), F.col("label").alias("la")).distinct(), "a")
                       .join(now.select(F.col("cid").alias("b"), F.col("label").alias("lb")).distinct(), "b").where("la <> lb").select("a", "b"))
                got = saved(got, "verified", parts)
                if got.take(1):
                    links = got if links is None else links.unionByName(got)
                    labels = saved(components(links, parts=parts), "labels", parts)
                    now = (now.drop("label").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
                           .withColumn("label", F.coalesce("label", "cid")))
                    now = saved(now, "left", parts)
                few = now.join(small_or_plain(size, ROW_BYTES), "tok", "left_anti")
            else:
                few = now
            there = few.select(F.col("tok").alias("tok2"), *[F.col(c).alias(f"{c}2") for c in _SIDE], *[F.col(f"x{i}").alias(f"y{i}") for i in range(SKETCH)])
            cand = (few.join(there, F.expr("tok = tok2 and label < label2") & _comparable(num, den) & bound & _may_link(num, den))
                    .select("cid", "n", "cid2", "n2"))
            if crowded:
                cand = cand.unionByName(_crowd_pairs(diff, apart, now, num, den, parts))
        pairs = _ordered_pairs(cand)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs", parts)
        if not pairs.take(1):
            if turn <= neighbour_rounds:
                continue
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        got = saved(_verify(pairs, segs, num, den, parts), "verified", parts)
        links = got if links is None else links.unionByName(got)
        labels = saved(components(links, parts=parts), "labels", parts)
    first = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"))
    if labels is not None:
        first = first.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        lows = first.groupBy("label").agg(F.min("low").alias("component_id"))
        first = first.select("cid", "label").join(lows, "label")
    else:
        first = first.select("cid", F.col("cid").alias("label"), F.col("low").alias("component_id"))
    first = saved(first.select("cid", F.col("label").alias("component"), "component_id"), "components", parts)
    linked = F.col("n") > 0
    return (rows.select("doc_id", "key", "cid", "n").join(first, "cid", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(linked, F.col("component")).alias("component"), "key"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents, all their columns, without all but one of each group of
    linked documents: the one with the smallest doc_id (null first), then
    content key, stays.  Of rows alike in both, one stays."""
    rows = saved(jaccard_components(docs, **how).where("component is not null").select("component", "doc_id", "key"), "groups")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.count("*").alias("n")).where("n > 1")
    lost = (rows.join(best, "component").where(~F.struct("doc_id", "key").eqNullSafe(F.col("best")))
            .select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    lost = small_or_plain(saved(lost, "lost"), ROW_BYTES)
    d = docs.withColumn("__k", text_key())
    d = d.join(lost, (F.col("__k") == F.col("__key")) & d["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")
    if rows.groupBy("doc_id", "key").count().where("count > 1").take(1):
        d = d.dropDuplicates(["doc_id", "__k"])
    return d.drop("__k")


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS t
      FROM (SELECT r, w, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(r, q) AS (SELECT r, r FROM w UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.q)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r)
JOIN (SELECT reach.r, min(v.doc_id) AS component_id FROM reach JOIN w v ON v.r = reach.q GROUP BY reach.r) c USING (r)
"""
