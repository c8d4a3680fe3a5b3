"""The operators on small tables: brute force, and nulls, empty and long
texts, ties, repeated rows, empty tables and clashing extra columns."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from leverkit.llm import chat, ctw, decontaminate, jaccard, langid, lines, mixing, neighbours, privacy, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=1, n=40):
    """Random texts, near and exact copies, shared lines, and the edge cases."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(k))
    rows, base = [], [say(r.randint(30, 60)) for _ in range(n // 4)]
    common = say(8)
    for i in range(n):
        text = r.choice(base).split() if r.random() < 0.6 else say(r.randint(1, 40)).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            text[r.randrange(len(text))] = r.choice(WORDS)
        text = " ".join(text[:10]) + "\n" + " ".join(text[10:])
        if r.random() < 0.4:
            text += "\n" + common + r.choice(["", "!", "!?", "?!."])
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "ü", None]), len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t ", "en", "b", 3),
             (103, "One", None, "b", 3), (104, "One two", "fr", None, 7), (None, base[0], "en", "a", 1),
             (0, rows[0][1], rows[0][2], rows[0][3], rows[0][4]), (105, say(5000), "en", "b", 1),
             (106, "naïve Ünïcode 😀 text " * 5, "fr", "ü", 1), (107, "1234 5678", "en", "a", 9)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Two partitions and extra columns named as inner or output columns."""
    return spark.createDataFrame(rows, DOC).repartition(2).withColumns(
        {c: F.lit(7) for c in ("key", "size", "target", "start", "cid", "label", "score", "n", "h", "id", "out", "rank")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# ---------------------------------------------------------------- mixing

def targets(sizes, cap=3, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return got | share
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
            free.remove(s)


def test_mixing(spark, rows, docs, empty):
    got = [r.asDict() for r in mixing.mix_sources(docs).collect()]
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["size"] == len(space_words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 0.5) for s in sizes)
    again = {(r["doc_id"], r["text"]): r["taken"] for r in map(lambda r: r.asDict(), mixing.mix_sources(docs.repartition(5)).collect())}
    assert all(again[r["doc_id"], r["text"]] == r["taken"] for r in got if r["doc_id"] != 0)
    assert mixing.mix_sources(empty).collect() == []


def test_mixing_moves_sizes_only(spark, docs):
    """The documents are not shuffled, and take what the sort of whole rows
    gives them; rows alike in id and size at a cut included."""
    plain = docs.dropDuplicates(["doc_id"]).checkpoint()
    got = mixing.mix_sources(plain)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    alike = spark.createDataFrame([(None if i % 4 else i, f"w{i} x y", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    for d in (plain, alike, alike.where("doc_id is not null or text = 'w3 x y'")):
        whole = mixing.mix_sized(d.select("doc_id", "source", mixing.word_count().alias("size")))
        cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
        assert Counter(map(tuple, mixing.mix_sources(d).select(cols).collect())) == Counter(map(tuple, whole.select(cols).collect()))


# ---------------------------------------------------------------- decontamination

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark, rows, docs, empty):
    long = bench_words(rows[3][1])
    items = [(1, " ".join(long[2:20])), (2, "One TWO"), (3, None), (4, "  "), (5, rows[5][1]), (None, "three words here"),
             (10, " ".join(long[2:20])), (6, "naïve ünïcode"), (7, " ".join(bench_words(rows[-3][1])[4000:4030]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wins[tuple(w[s:s + n])].add(str(i).replace("None", "null"))
    want = Counter()
    for d, text, *_ in rows:
        w, hit, ids = bench_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s:s + n])) in wins:
                    hit |= set(range(s, s + n))
                    ids |= wins[g]
        want[d, len(w), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated)
                  for r in decontaminate.contamination(docs, bench).collect())
    assert got == want and any(k[4] for k in want)
    bad = {k[0] for k in want if k[4]}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {r[0] for r in rows} - bad
    assert not any(r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(empty, bench).collect() == []


# ---------------------------------------------------------------- Jaccard join

def brute_components(rows):
    def shingles(t):
        w = space_words(t)
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    least = lambda x: min((y for y in x if y is not None), default=None)
    return Counter((r[0], len(s), least(low[find(i)]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed):
    r = random.Random(seed)
    rows = corpus(seed, 30)
    base = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(120)]
    for i in range(60):  # a group of near copies, some of them on the threshold
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = f"x{r.randint(0, 9)}"
        rows.append((200 + i, " ".join(t[:r.randint(105, 120)]), "en", "a", 1))
    got = Counter((x.doc_id, x.n_shingles, x.component_id)
                  for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect())
    assert got == brute_components(rows)


def test_jaccard_pairs_just_below_the_threshold(spark, monkeypatch):
    """A group of near copies, each shingle in half of them, no two linked:
    hardly any pair is left to compare."""
    rnd, n, made = random.Random(4), 60, []
    texts = [" ".join(f"w{i}" if i % 5 else f"w{i}{rnd.choice('xy')}" for i in range(60)) for _ in range(n)]
    plain = jaccard.saved

    def spy(df, name="t", parts=None):
        out = plain(df, name, parts)
        if name == "pairs":
            made.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "saved", spy)
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), neighbour_rounds=0).collect()
    assert len(got) == n and all(r.component_id <= r.doc_id for r in got)
    assert made[-1] < n, made


def made_by_joins(df):
    """Rows that each join of a frame's run put out."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if "Join" in node.nodeName():
                out.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize(("seed", "crowd", "rounds"), [(1, 1, 0), (2, 1, 2), (3, 4, 0), (4, 1, 0)])
def test_jaccard_crowds(spark, monkeypatch, seed, crowd, rounds):
    """Buckets told apart by their pivots give the links of the brute force."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    r = random.Random(seed)
    rows = corpus(seed, 20)
    base = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(120)]
    for i in range(90):  # on both sides of the threshold, by changes that are shared or not
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(0, len(t), r.choice([1, 7, 20]))] = f"x{r.randint(0, r.choice([1, 1000]))}"
        rows.append((200 + i, " ".join(t[r.choice([0, 0, 6]):r.randint(105, 120)]), "en", "a", 1))
    got = Counter((x.doc_id, x.n_shingles, x.component_id)
                  for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOC), neighbour_rounds=rounds).collect())
    assert got == brute_components(rows)


def test_jaccard_large_group_beside_a_component(spark, monkeypatch):
    """Copies of one text with one to three words changed: those that do not
    link are not paired with each class of the group's component."""
    r, n, made = random.Random(8), 400, []
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base), "en", "a", 1)]
    for i in range(1, n):
        t = list(base)
        for at in r.sample(range(150), r.choice([1, 1, 2, 3])):
            t[at] = f"x{r.randint(0, 40)}"
        rows.append((i, " ".join(t), "en", "a", 1))
    plain = jaccard._ordered_pairs

    def spy(df):
        made.append(made_by_joins(df))
        return plain(df)
    monkeypatch.setattr(jaccard, "_ordered_pairs", spy)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect())
    assert got == brute_components(rows)
    last = max(made[-1])
    assert len(made) == jaccard.NEIGHBOUR_ROUNDS + 2 and last < 25 * n, made


def test_jaccard_rarest_of_the_whole_set(spark, monkeypatch):
    """Texts mostly of one common passage, the rest of passages that a few of
    them share: told apart by their rarest shingles, not by what all have."""
    r, n, listed = random.Random(5), 150, []
    say = lambda k, name: [f"{name}{i}" for i in range(k)]
    common, pool = say(120, "c"), [say(30, f"p{j}x") for j in range(20)]
    rows = []
    for i in range(n):
        a, b = sorted(r.sample(range(20), 2))
        rows.append((i, " ".join(common + pool[a] + pool[b]), "en", "a", 1))
    rows += [(n + i, rows[i][1] + " end", "en", "a", 1) for i in range(0, n, 10)]
    plain = jaccard.saved

    def spy(df, name="t", parts=None):
        out = plain(df, name, parts)
        if name == "differences":
            listed.append(out.agg(F.sum(F.size("d"))).first()[0])
        return out
    monkeypatch.setattr(jaccard, "saved", spy)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect())
    assert got == brute_components(rows)
    assert sum(listed) < n, listed


def test_jaccard_edges(spark, rows, docs, empty):
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs).collect())
    assert got == brute_components(rows)
    kept = jaccard.drop_near_copies(docs).collect()
    groups = defaultdict(list)
    for (d, n, c), _ in brute_components(rows).items():
        groups[(d,) if n == 0 else c].append(d)
    assert len(kept) == len(groups) and kept[0].__fields__ == docs.columns
    assert jaccard.jaccard_components(empty).collect() == [] and jaccard.drop_near_copies(empty).collect() == []


# ---------------------------------------------------------------- line dedup

def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutate(r, s, edits, letters):
    s = list(s)
    for _ in range(edits):
        i = r.randint(0, len(s))
        kind = r.random()
        if kind < 0.33 or not s:
            s.insert(i, r.choice(letters))
        elif kind < 0.66:
            s[min(i, len(s) - 1)] = r.choice(letters)
        else:
            del s[min(i, len(s) - 1)]
    return "".join(s)


def test_edit_distance():
    r = random.Random(5)
    for _ in range(6000):
        a = "".join(r.choice("abü") for _ in range(r.randint(0, 16)))
        b, k = mutate(r, a, r.randint(0, 6), "abü"), r.randint(0, 4)
        assert lines.edit_at_most(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_segment_keys_meet():
    r = random.Random(6)
    for _ in range(1500):
        tau = r.randint(1, 4)
        a = "".join(r.choice("ab") for _ in range(r.randint(10, 30)))
        b = mutate(r, a, r.randint(0, tau), "ab")
        s, t = sorted((a, b), key=len)
        index, _, _, p = lines.segment_keys([s], tau)
        own, probe, ok, q = lines.segment_keys([t], tau)
        assert set(index[0]) & {*own[0], *probe[0][ok[0]]}
        assert bin(int(p[0]) ^ int(q[0])).count("1") <= 2 * tau


def brute_lines(rows, tau=lines.TAU, least=lines.MIN_CHARS):
    where = defaultdict(list)
    key = lambda t: hashlib.md5(("t" + t).encode()).digest()
    seen = []
    for d, t, *_ in {(r[0], r[1]): r for r in rows if r[1]}.values():
        for i, s in enumerate(t.split("\n")):
            at = (-1 if d is None else d, key(t), i)
            seen.append((d, i, s, at))
            if len(s) >= least and s.strip() or len(s.strip(" ")) >= lines.MIN_EXACT:
                where[s].append(at)
    names = list(where)
    up = {s: s for s in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(names, 2):
        if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
            up[find(a)] = find(b)
    first = {}
    for s in names:
        first[find(s)] = min([*where[s], *([first[find(s)]] if find(s) in first else [])])
    out = []
    for d, i, s, at in seen:
        f = first[find(s)] if s in up else at
        out.append((d, i, None if f[0] == -1 else f[0], f[2], f == at))
    return Counter(out)


def test_lines(spark, rows, docs, empty):
    short = [r for r in rows if r[0] != 105]  # the very long line is checked below
    got = lines.line_classes(docs.where("doc_id is null or doc_id <> 105")).dropDuplicates(["doc_id", "key", "line_no"]).collect()
    assert Counter((r.doc_id, r.line_no, r.first_doc, r.first_line, r.kept) for r in got) == brute_lines(short)
    assert any(not r.kept and r.doc_id != r.first_doc for r in got)
    out = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert out[105].text == rows[-3][1] and out[100].text is None and out[101].text == "" and out[102].text == " \n\t "
    gone = {k[0] for k in brute_lines(short) if not k[4]}
    assert all(out[r[0]].text == r[1] for r in short if r[0] in out and r[0] not in gone)
    assert lines.line_classes(empty).collect() == [] and lines.dedup_lines(empty).collect() == []
    long = "".join(random.Random(3).choice("abc ") for _ in range(60_000))
    pair = spark.createDataFrame([(1, long), (2, long[:30_000] + "Z" + long[30_000:]), (3, long + "yyy")], "doc_id long, text string")
    assert sorted((r.doc_id, r.first_doc) for r in lines.line_classes(pair).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_short_lines_meet_exact_copies(spark):
    """A short footer is cut from all but its first document, a copy of short
    lines goes whole; near copies of short lines, scraps and blanks stay."""
    rows = [(1, "Menu\nHome\nab\n \nOf."), (2, "Menu\nHone\nab\n \nrest of it"), (3, "Menu\nHome\nOf."), (4, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == {1: rows[0][1], 2: "Hone\nab\n \nrest of it", 4: "ab"}


def test_frequent_lines(spark, docs, monkeypatch):
    """Lines told of by broadcast and lines joined by their digest give the same."""
    def got():
        return Counter(map(tuple, lines.line_classes(docs).collect()))
    want = got()
    for share in (1, 10, 1 << 40):  # none, some, all that occur twice
        monkeypatch.setattr(lines, "HEAVY", share)
        assert got() == want


# ---------------------------------------------------------------- language ID

def test_language_id_memory():
    """A batch of 4 MB of text is worked on in pieces: its arrays would take
    hundreds of megabytes in each worker."""
    import tracemalloc

    import pyarrow as pa
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh üß", k=2000)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en", "fr"] * 1000})
    model = langid.Model(["en", "fr"], np.full((langid.SLOTS, 1), 3, np.uint8), 0)
    for run in (langid._predict(type("Sent", (), {"value": model})), langid._count(["en", "fr"])):
        tracemalloc.start()
        assert sum(x.num_rows for x in run([batch])) >= 2000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20, peak


def test_language_id(spark, docs, empty, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.id_hash(4) == 2
    p = langid.predict(d.where(out), langid.learn(d.where(~out))).collect()
    assert sum(r.lang == r.lang_pred for r in p) >= 0.97 * len(p) and all(0 <= r.score <= 1 for r in p)
    m = langid.learn(docs)
    got = langid.predict(docs, m).collect()
    assert m.langs == ["en", "fr"]
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    none = langid.learn(empty)
    assert none.langs == [] and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, m).collect() == []


def test_bloom_rows_hold_every_gram(spark):
    d = spark.createDataFrame([(1, "abcd", "x"), (2, "wxyz", "y"), (3, "same", "x"), (4, "same", "y")], "doc_id long, text string, lang string")
    m = langid.learn(d)
    for _, _, g, ends in langid._grams(__import__("pyarrow").array(["abcd", "same"])):
        hit = np.bitwise_and.reduce([m.rows[s] for s in langid.gram_slots(g)])[:, 0]
        assert (hit[:ends[1]] & 1 == 1).all() and (hit[ends[1]:] == 3).all()


# ---------------------------------------------------------------- personal data

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_base(spark, docs, empty):
    r = random.Random(8)
    bits = ["a@b.c", "x.y@z-1.com", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
            "+", "99", " ", "é", "😀", "-", "_", "\n", "00255.1.1.1", "5", "a", "%", "123.45.67.89.10.11.12.13", "u@h.i_j@k.l"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(400)]
    texts += [None, "", "9" * 30_000, "a" * 30_000 + "@", "a" * 20_000 + "@b.c", "+1" + " 2" * 20_000, "1." * 20_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in privacy.scan(d).collect():
        assert [(s.start, s.kind, s.end) for s in x.spans] == brute_pii(texts[x.doc_id]), texts[x.doc_id][:200]
    assert privacy.personal_data(empty).collect() == [] and privacy.sanitise(empty).collect() == []
    assert len(privacy.personal_data(docs).collect()) == docs.count()


TERM = regex.compile(r"(?<!\p{L})(?:\p{L}{3,}|[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]{2})(?!\p{L})")


def brute_terms(texts, context=privacy.CONTEXT, threshold=privacy.THRESHOLD, support=privacy.SUPPORT):
    """Spans of the terms that give away an entity, by the definition."""
    def entities(t):
        spans = brute_pii(t)
        for i, (a, k, b) in enumerate(spans):
            lo = max(a - context, min(spans[i - 1][2] if i else 0, a))
            hi = min(b + context, max(spans[i + 1][0] if i + 1 < len(spans) else len(t), b))
            left, right = (t[lo - 1] if lo else " ") + t[lo:a] + " ", " " + t[b:hi] + (t[hi] if hi < len(t) else " ")
            value = t[a:b].lower() if k == 0 else t[a:b] if k == 1 else re.sub("[^0-9]", "", t[a:b])
            yield (k, value), (left, right), {m[0].lower() for x in (left, right) for m in TERM.finditer(x)}

    def outside(t):
        hidden = list(t)
        for a, _, b in brute_pii(t):
            hidden[a:b] = " " * (b - a)
        return {m[0].lower() for m in TERM.finditer("".join(hidden))}
    n_e, n_t, n_et, in_texts, in_contexts = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for t in texts:
        found, terms = list(entities(t)), outside(t)
        n_t.update({m[0].lower() for m in TERM.finditer(t)})
        for e in {e for e, _, _ in found}:
            n_e[e] += 1
            for w in terms:
                n_et[e, w] += 1
                in_texts[e, w].add(t)
        for e, where, near in found:
            for w in near:
                in_contexts[e, w].add(where)
    bad = defaultdict(set)
    for (e, w), n in n_et.items():
        ic = -math.log2(n_e[e] / len(texts))
        pmi = math.log2(len(texts) * n / (n_e[e] * max(n_t[w], n)))
        if max(len(in_texts[e, w]), len(in_contexts[e, w])) >= support and ic > 0 and pmi / ic >= threshold:
            bad[e].add(w)
    out = []
    for t in texts:
        wanted = {w for e, _, _ in entities(t) for w in bad[e]}
        base = brute_pii(t)
        out.append([(m.start(), m.end(), m[0].lower()) for m in TERM.finditer(t)
                    if m[0].lower() in wanted and not any(a < m.end() and m.start() < b for a, _, b in base)])
    return out


def test_disclosing_terms_brute_force(spark):
    r = random.Random(21)
    words = ["the", "of", "met", "Quagga", "okapi", "zanzibar", "Gnu", "ibis", "李", "한국", "été", "a", "line\n", "jo", "x"]
    names = ["jo@x.org", "al@quagga.net", "10.1.2.3", "+1 555 123 4567", "4111 1111 1111 1111"]
    texts = [" ".join(r.choice(words) if r.random() < 0.9 else r.choice(names) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [" ".join(r.choice(["the", "of", "met", "a"]) for _ in range(9)) for _ in range(150)]
    texts += [f"{w} {'the of ' * k}{e}" for w, e in (("王芳", "wf@y.cn"), ("李", "li@y.cn"), ("Okapi", "ok@z.org")) for k in (1, 30)] + texts[:3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold, least in ((privacy.THRESHOLD, {"王芳"}), (0.2, {"王芳", "quagga", "한국"})):
        got = {x.doc_id: [(s.start, s.end, s.s) for s in x.term_spans] for x in privacy.personal_data(d, threshold=threshold).collect()}
        want = brute_terms(texts, threshold=threshold)
        assert [got[i] for i in range(len(texts))] == want
        assert {s[2] for x in want for s in x} >= least


def test_many_entities_in_one_text(spark):
    """Positions stay exact, and the text is cut and joined right, over many
    pieces and blocks; spans that overlap are joined."""
    text = "".join(f"é{'😀' * (i % 5)} Name{chr(97 + i % 26) * 3} u{i}@h{i % 7}.org, +1 555 {1000000 + i} 10.0.{i % 200}.1@k.io; " for i in range(4000))
    d = spark.createDataFrame([(1, text), (2, "Namezzz u25@h4.org"), *((i, "none") for i in range(3, 40))], "doc_id long, text string")
    got = {x.doc_id: x for x in privacy.personal_data(d).collect()}[1]
    base = brute_pii(text)
    assert [(s.start, s.kind, s.end) for s in got.spans] == base
    assert got.term_spans and [(s.start, s.end) for s in got.term_spans if s.s == "namezzz"] == [m.span() for m in re.finditer("Namezzz", text)]
    spans = sorted(base + [(s.start, s.kind, s.end) for s in got.term_spans])
    at, want = 0, []
    for a, k, b in spans:
        want += [text[at:a], ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"][k]] if a >= at else []
        at = max(at, b)
    assert {x.doc_id: x.text for x in privacy.sanitise(d).collect()}[1] == "".join(want) + text[at:]


def test_disclosing_terms(spark):
    rows = [(i, f"We met zanzibar{'' if i % 2 else ' once'} and his mail jo@x.org is here for all number {i}", None) for i in range(3)]
    rows = [(i, t.replace("zanzibar", "Zanzibar"), s) for i, t, s in rows]
    rows += [(10 + i, f"nothing here for all of us, and his line {i} is met", None) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {x.doc_id: [s.s for s in x.term_spans] for x in privacy.personal_data(d).collect()}
    assert all("zanzibar" in got[i] and "for" not in got[i] and "his" not in got[i] for i in range(3))
    assert all(not got[10 + i] for i in range(60))
    clean = {x.doc_id: x.text for x in privacy.sanitise(d).collect()}
    assert "[EMAIL]" in clean[1] and "[TERM]" in clean[1] and "Zanzibar" not in clean[1] and "jo@x.org" not in clean[1]
    assert clean[10] == rows[3][1]
    removed = {x.doc_id: x.text for x in privacy.sanitise(d, remove=True).collect()}
    assert "[" not in removed[1] and "Zanzibar" not in removed[1]


def test_disclosing_terms_anywhere_in_the_document(spark):
    far = "nothing here for all of us, and his line is met " * 3
    # near and far; far only, on both sides; behind a neighbouring entity
    texts = [f"Zanzibar {i} {far}and jo@x.org {far}{i} zanzibar" for i in range(3)] + [f"ZANZIBAR {far}jo@x.org {i} for zanzibar" for i in range(2)]
    texts += [f"{i} Quagga {far}from 10.1.2.{7}" for i in range(3)]
    texts += [f"{i} Okapi u{i}@y.org v{i}@y.org +1 555 123 4567" for i in range(3)]
    once = len(texts)
    texts += [f"Gnu {far}sole@z.org", f"Gnu {far}sole@z.org", "Zanzibar alone"]  # copies are one text
    texts += [f"{far}{i}" for i in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.term_spans for x in privacy.personal_data(d).collect()}
    for i, word in [(i, "zanzibar") for i in range(5)] + [(i, "quagga") for i in range(5, 8)] + [(i, "okapi") for i in range(8, 11)]:
        want = [m.span() for m in re.finditer(word, texts[i], re.I)]
        assert want == [(s.start, s.end) for s in got[i] if s.s == word], texts[i]
        assert not {s.s for s in got[i]} & set(far.replace(",", "").split())
    assert all(got[i] == [] for i in range(once, len(texts)))
    assert all(w not in x.text.lower() for x in privacy.sanitise(d).collect() if x.doc_id < once for w in ("zanzibar", "quagga", "okapi"))


# ---------------------------------------------------------------- language model

def brute_ctw(train, texts, depth):
    """The definition, by recursion over dicts."""
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    counts = defaultdict(lambda: [0, 0])

    def events(t):
        b = t.translate(LOWER).encode() + b"\xff"
        for i, x in enumerate(b):
            past = (b"\xff" * depth + b[:i])[-depth:]
            for bit in range(8):
                yield past, (1 << bit) + (x >> (8 - bit)), x >> (7 - bit) & 1
    for t in train:
        for past, tree, bit in events(t):
            for d in range(depth + 1):
                counts[tree, past[depth - d:]][bit] += 1
    kids = defaultdict(list)
    for tree, c in list(counts):
        if c:
            kids[tree, c[1:]].append(c)
    memo = {}

    def parts(tree, c):
        if (tree, c) not in memo:
            own = kt(*counts[tree, c])
            below = sum(parts(tree, x)[1] for x in kids.get((tree, c), ())) if len(c) < depth else None
            memo[tree, c] = (1.0, own) if below is None else (1 / (1 + math.exp(min(700, below - own))), math.log(0.5) + np.logaddexp(own, below))
        return memo[tree, c]
    out = []
    for t in texts:
        total = 0.0
        for past, tree, bit in events(t):
            p = None
            for d in range(depth, -1, -1):
                c = past[depth - d:]
                if (tree, c) in counts:
                    a = counts[tree, c]
                    own = (a[bit] + 0.5) / (sum(a) + 1)
                    w = parts(tree, c)[0]
                    p = own if p is None else w * own + (1 - w) * p
            total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_context_tree_weighting(spark, empty):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS[:6]) for _ in range(r.randint(1, 8))) + r.choice(["", "É", "\n"])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "Quite NEW wörds 😀"), (None, "alpha beta"), (3, rows[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    train = [t or "" for i, t in rows if not held(i)]
    got = {(x.doc_id, x.held_out): x for x in ctw.ctw_scores(d, depth=3).collect()}
    want = brute_ctw(train, [t or "" for _, t in rows], 3)
    c = Counter(w for t in train for w in [*space_words(t), "\0"])
    n, v = sum(c.values()), len(c)
    for (i, t), score in zip(rows, want, strict=True):
        x, toks = got[i, held(i)], [*space_words(t), "\0"]
        assert math.isclose(x.score, score, rel_tol=1e-5, abs_tol=1e-5)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(toks), sum(c[w] > 0 for w in toks), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks), rel_tol=1e-9)
    assert ctw.ctw_scores(empty).collect() == []


def test_bytes_after_a_context_sum_to_one(spark):
    keys, n = np.unique(np.array([0x61620063, 0x61620064, 0x61630061], np.uint64), return_counts=True)
    every = np.sort(np.unique(np.concatenate([keys, (0x616200 << 8) + np.arange(256, dtype=np.uint64), (0x7A7A00 << 8) + np.arange(256, dtype=np.uint64)])))
    count = np.where(np.isin(every, keys), 5, 0)
    counts, weight = np.zeros((2, 256, 256, 2), np.int64), np.full((2, 256, 256), 0.3)
    p = 10 ** ctw.log10_probabilities(every, count, 3, counts, weight)
    for c in (0x616200, 0x7A7A00):
        assert math.isclose(p[every >> np.uint64(8) == c].sum(), 1.0, rel_tol=1e-9)


# ---------------------------------------------------------------- neighbours

def test_neighbours(spark):
    g = np.random.default_rng(1)
    x = (g.standard_normal((3000, 16)) * g.random((3000, 1)) * 3).astype(np.float32)
    x[100:130] = x[40]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(4000, None, 1), (4020, [0.0] * 16, 1), (4040, [float("nan")] * 16, 1), (4060, [1.0] * 15 + [None], 1),
             (4080, [1.0] * 3, 1), (4100, [float("inf")] + [0.0] * 15, 1), (None, [1.0] * 16, 1), (7, x[7].tolist(), 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found, total = 0, 0
    got = defaultdict(list)
    for r in neighbours.search(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 3000, 20))
    y = x.astype(float)
    for q, rs in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(3000), -s))[:20]
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and q not in [r.vec_id for r in rs]
        assert all(math.isclose(r.score, s[r.vec_id], rel_tol=1e-12) for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        found, total = found + len({r.vec_id for r in rs} & set(top.tolist())), total + 20
    assert found >= 0.9 * total
    assert neighbours.search(d.limit(0)).collect() == []
    few = neighbours.search(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, score int")).collect()
    assert {r.query_id for r in few} <= {0} and len(few) <= 4


def test_every_query_gets_k_neighbours(spark):
    """A dense region, and a group of 10 far from it that a query meets in each table."""
    g = np.random.default_rng(3)
    x = np.concatenate([np.full((3000, 16), 0.25) + g.standard_normal((3000, 16)) * 0.05,
                        np.full((10, 16), -0.25) + g.standard_normal((10, 16)) * 1e-4])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.search(d).collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 3010, 20))
    assert all(len(set(v)) == len(v) == 20 for v in got.values())
    assert set(range(3001, 3010)) <= set(got[3000])
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[-10:])], "vec_id long, embedding array<float>")
    assert {r.vec_id for r in neighbours.search(few).collect()} == set(range(1, 10))


# ---------------------------------------------------------------- tokens

def test_token_counts(spark, rows, docs, empty):
    r = random.Random(2)
    chars = sorted(set("".join(WORDS)) | set("▁0123456789é"))
    scores = {c: -9.0 - r.random() for c in chars}
    for w in WORDS:
        for _ in range(6):
            a = r.randrange(len(w))
            scores["▁" * (r.random() < 0.3) + w[a:a + r.randint(2, 5)]] = -3.0 - r.random() * 4
    model = tokens.Unigram(scores)

    def brute(word):
        best = [(0.0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            best[e] = (best[e - 1][0] + n * model.byte, -(-best[e - 1][1] + n))
            for s in range(e):
                if word[s:e] in scores:
                    best[e] = max(best[e], (best[s][0] + scores[word[s:e]], best[s][1] - 1))
        return -best[-1][1]
    got = {(x.doc_id, x.n_words, x.n_tokens) for x in tokens.token_counts(docs, scores).collect()}
    want = {(d, len((t or "").split()), sum(brute("▁" + w) for w in (t or "").split())) for d, t, *_ in rows if d != 106}
    assert want <= got
    assert tokens.token_counts(empty, scores).collect() == []
    assert model.counts(["▁" + "x" * 5000]) == [1 + 5000 if "x" not in scores else model.counts(["▁" + "x" * 5000])[0]]


# ---------------------------------------------------------------- chat

def test_chat_tree(spark):
    r = random.Random(9)
    parts = ["hi", "", None, "a\\b", "<|im_end|>", "<|", "\\|", "\n", "x\\n", "é😀", "<|im_start|>assistant\nok<|im_end|>\n", "\\"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "od\nd", "<|x"]) if t else "user", r.choice(parts[:5] if t < 3 else parts))
            for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(90, 0, "user", "hi"), (90, 0, "user", "hi"), (None, None, "assistant", "z" * 30_000), (91, 0, "assistant", "hi"), (91, None, "user", "q")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).repartition(3)
    nodes, steps, heads = chat.format_conversations(d)
    by = defaultdict(list)
    for c, t, a, b in sorted(rows, key=lambda x: (x[0] is None, x[0], x[1] is not None, x[1], x[2] or "", x[3] or "")):
        by[c].append((a or "", b or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(c, len(x), sha("".join(f"{a}\n{b}\n" for a, b in x)), sum(len(b) for a, b in x if a == "assistant"),
             sha("".join(b for a, b in x if a == "assistant")), sum(len(chat.format_turn(a, b)[0]) for a, b in x)) for c, x in by.items()}
    assert {tuple(x) for x in chat.read_back(nodes, steps, heads).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()} == want
    # every distinct prefix once; packed without gaps, depth first; intervals hold the subtree
    tree = {bytes(x.key): x for x in nodes.collect()}
    assert len(tree) == len({tuple(x[:i + 1]) for x in by.values() for i in range(len(x))}) == nodes.count()
    order = sorted(tree.values(), key=lambda x: x.start)
    at, path = 0, []
    for x in order:
        assert x.start == at
        at += x.length
        del path[x.depth - 1:]
        assert bytes(x.parent) == (path[-1] if path else b"")
        assert x.position == sum(tree[k].length for k in path)
        assert all(tree[k].start <= x.start < tree[k].subtree_end for k in path)
        assert {bytes(y.key) for y in order if y.start <= x.start < y.subtree_end} == {*path, bytes(x.key)}
        path.append(bytes(x.key))
    assert chat.read_back(*chat.format_conversations(d.limit(0))).collect() == []
