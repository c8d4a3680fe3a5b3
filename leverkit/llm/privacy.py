"""Operator 9: personal data, with information-theoretic sanitisation.

Protected entities are the e-mail addresses, IP addresses, card numbers and
phone numbers that patterns find.  A term (word of three letters or more, of two
in Han, kana and hangul) in a document with an entity reveals it as far as the corpus says so: with N
documents, n(e) of them naming the entity, n(t) containing the term and
n(e, t) naming the entity and containing the term outside of all entities,

    PMI(e; t) = log2(N n(e, t) / (n(e) n(t))),   IC(e) = -log2(n(e) / N),

and the term's disclosure is PMI / IC: 1 if the term gives the entity away,
0 or less if it says nothing.  Terms at or above a threshold, seen with the
entity in two different texts at least, or near it in two different contexts,
are generalised (or removed) wherever they stand in the documents that name
the entity, as the entity itself is.

DataFrame functions only.  Positions are counted from the lengths of what lies
between matches: ``split`` and ``regexp_extract_all`` walk the same matches.  A
text is cut in pieces of fixed length once, and running sums go by blocks, so
the work grows with the text and, in its n spans, with n times their root.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leverkit.llm.common import saved, small_or_plain, table, text_key

#: the kinds in the order in which spans that begin together are listed
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Possessive forms of the patterns: what follows a run can never lie in the
#: run, so nothing is lost by not giving it back, and neither the stack nor the
#: time grows with its length.  A match begins where a run begins, or where the
#: last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_OK = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: code points on each side of an entity, up to the next entity, that are its
#: context: two of them in one text support a term as two texts do
CONTEXT = 60
THRESHOLD = 0.8
SUPPORT = 2
#: scripts in which two letters are a word or a name
_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2}"
_TERM = rf"(?<=[^\p{{L}}])(?:\p{{L}}{{3,}}+|{_DENSE})(?=[^\p{{L}}])"
#: code points of a piece of a text; see _pieces
PIECE = 512


def _let(value: Column, body) -> Column:
    """body(value) with the value found once.  Inside a function over an array
    an expression from outside is evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, first, step) -> Column:
    """What ``step`` has made of ``first`` before each of the (integer) values."""
    return F.aggregate(values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
                       lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                       lambda acc: acc["out"])


def _larger(u: Column, v: Column) -> Column:
    return F.greatest(u, v)


def _before(values: Column, step) -> Column:
    """The running sum or maximum of an array of integers, from 0 and without
    the value itself.  Appending copies what is there, so the array is cut into
    blocks of the root of its size: n values cost n times that root."""
    zero = F.lit(0)

    def by_blocks(blocks):
        total = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
        return F.flatten(F.zip_with(blocks, _scan(total, zero, step), lambda b, at: _scan(b, at, step)))

    def cut(a, size):
        return F.transform(F.sequence(zero, F.size(a) - 1, size), lambda i: F.slice(a, i + 1, size))

    return _let(values, lambda a: F.when(F.size(a) > 0, _let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda n: _let(
        cut(a, n), by_blocks))).otherwise(F.array().cast("array<int>")))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points: a substring of a whole text
    walks the text from its start, one of its pieces only these."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))


def _cut(pieces: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (counted from 0) of a text in pieces."""
    low = F.floor(start / PIECE).cast("int")
    n = F.floor((start + size - 1) / PIECE).cast("int") - low + 1
    return F.when(size > 0, F.substring(F.array_join(F.slice(pieces, low + 1, n), ""), start - low * PIECE + 1, size)).otherwise(F.lit(""))


def _found(text: Column, pattern: str, ok, offset: Column | None = None) -> Column:
    """array<struct<start, end, s>> of the matches for which ok(match) holds."""
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zero = (F.lit(0) if offset is None else offset).cast("int")
    pairs = _let(hit, lambda h: F.zip_with(h, F.slice(gaps, 1, F.greatest(F.lit(0), F.size(h))), lambda m, g: F.struct(m.alias("m"), g.alias("g"))))

    def placed(p):
        at = _before(F.transform(p, lambda x: x["g"] + F.length(x["m"])), lambda u, v: u + v)
        return F.zip_with(p, at, lambda x, u: F.struct(
            (zero + u + x["g"]).alias("start"), (zero + u + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("s")))

    return F.filter(_let(pairs, placed), lambda x: ok(x["s"]))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(
        i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _card_ok(m: Column) -> Column:
    d = F.translate(m, " -", "")
    return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))


_OK = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_IP_OK),
    "card": _card_ok,
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15),
}
#: an entity's value, without the ways to write it
_VALUE = {
    "email": F.lower,
    "ip": lambda s: s,
    "card": lambda s: F.translate(s, " -", ""),
    "phone": lambda s: F.regexp_replace(s, "[^0-9]", ""),
}
#: a text without this has no match, which is cheaper to see
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPAN = "array<struct<start:int,kind:int,end:int,s:string>>"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, s>> of the base entities, in order."""
    out = []
    for k, kind in enumerate(KINDS):
        got = F.transform(_found(text, PATTERNS[kind], _OK[kind]), lambda x: F.struct(
            x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["s"].alias("s")))  # noqa: B023
        has = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")
        out.append(F.when(has, got).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*out))


def _terms_in(text: Column, offset: Column) -> Column:
    return F.transform(_found(text, _TERM, lambda m: F.lit(True), offset), lambda t: F.struct(
        F.lower(t["s"]).alias("term"), t["start"].alias("start"), t["end"].alias("end")))


def _near(text: Column, spans: Column, context: int) -> Column:
    """One struct an entity: kind, value, a digest of its context, and the
    terms around it with their places."""
    def one(pieces, size, s, i):
        before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
        lo = F.greatest(s["start"] - context, F.least(before, s["start"]))
        after = F.coalesce(F.get(spans, i + 1)["start"], size)
        hi = F.least(s["end"] + context, F.greatest(after, s["end"]))
        # one character more on the outer side tells a whole word from a cut one
        left = F.concat(F.when(lo > 0, _cut(pieces, lo - 1, F.lit(1))).otherwise(F.lit(" ")), _cut(pieces, lo, s["start"] - lo), F.lit(" "))
        right = F.concat(F.lit(" "), _cut(pieces, s["end"], hi - s["end"]),
                         F.when(hi < size, _cut(pieces, hi, F.lit(1))).otherwise(F.lit(" ")))
        value = F.lit(None).cast("string")
        for k, kind in enumerate(KINDS):
            value = F.when(s["kind"] == k, _VALUE[kind](s["s"])).otherwise(value)

        def told(around):
            terms = F.concat(_terms_in(around["left"], around["lo"] - 1), _terms_in(around["right"], s["end"] - 1))
            return F.struct(s["kind"].alias("kind"), value.alias("value"), F.xxhash64(around["left"], around["right"]).alias("context"), terms.alias("terms"))
        return _let(F.struct(left.alias("left"), right.alias("right"), lo.alias("lo")), told)
    return _let(_pieces(text), lambda pieces: _let(F.length(text), lambda size: F.transform(spans, lambda s, i: one(pieces, size, s, i))))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    runs = F.array_distinct(F.split(text, r"[^\p{L}]++"))
    return F.array_distinct(F.transform(F.filter(runs, lambda w: (F.length(w) >= 3) | w.rlike(f"^{_DENSE}$")), F.lower))


def _between(text: Column, spans: Column, glue: str, name=None) -> Column:
    """The text with ``name(span)`` (or nothing) and then ``glue`` for every
    span; a span that overlaps an earlier one only extends it."""
    def parts(pieces, size):
        def joined(at):
            head = F.zip_with(spans, at, lambda s, u: F.concat(
                _cut(pieces, u, s["start"] - u), F.when(s["start"] >= u, name(s)).otherwise(F.lit("")) if name else F.lit("")))
            end = F.greatest(F.lit(0), F.array_max(F.transform(spans, lambda s: s["end"])))
            return F.array_join(F.concat(head, F.array(_let(end, lambda e: _cut(pieces, e, size - e)))), glue)
        return _let(_before(F.transform(spans, lambda s: s["end"]), _larger), joined)
    return _let(_pieces(text), lambda pieces: _let(F.length(text), lambda size: parts(pieces, size)))


def _free(places: Column, spans: Column) -> Column:
    """The places (in order, apart from each other) that no span overlaps: of
    the spans that begin before a place's end, none ends after its start."""
    def event(x, at, place, end):
        return F.struct(at.cast("int").alias("at"), F.lit(place).alias("place"), end.alias("reach"), x.alias("x"))

    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x, x["start"], 0, x["end"])),
                                   F.transform(places, lambda x: event(x, x["end"] - 1, 1, F.lit(0)))))
    told = _let(events, lambda e: F.zip_with(e, _before(F.transform(e, lambda v: v["reach"]), _larger), lambda v, u: F.struct(
        v["place"].alias("place"), u.alias("u"), v["x"].alias("x"))))
    return F.transform(F.filter(told, lambda v: (v["place"] == 1) & (v["u"] <= v["x"]["start"])), lambda v: v["x"])


def scan(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """doc_id, key (content key), spans (base entities) and, of documents with
    an entity, near (see _near), terms (outside of entities) and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text.alias("text"))
    d = d.withColumn("spans", base_spans(F.col("text")))
    has = lambda c: F.when(F.size("spans") > 0, c)
    return d.select("doc_id", "key", "spans", has(_near(F.col("text"), F.col("spans"), context)).alias("near"),
                    has(_terms(_between(F.col("text"), F.col("spans"), " "))).alias("terms"), has(F.col("text")).alias("text"))


def _named() -> Column:
    """array<struct<kind, value>> of the distinct entities of a document;
    strings are told apart by their hash, structs one by one."""
    names = F.array_distinct(F.transform("near", lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), x["value"])))
    return F.transform(names, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("kind"), F.substring(x, 3, F.length(x)).alias("value")))


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """kind, value, term, support, disclosure for every entity and term that
    share ``support`` texts, or contexts, at least."""
    n_docs = found.count()
    texts = found.where("near is not null").groupBy("key").agg(F.count("*").alias("copies"), F.first("near").alias("near"), F.first("terms").alias("terms"))
    texts = saved(texts, "texts")
    near = texts.select(F.inline("near"))
    contexts = near.groupBy("kind", "value", "context").agg(F.lit(1).alias("one")).groupBy("kind", "value").agg(F.count("*").alias("contexts"))
    entities = (texts.select("copies", F.inline(_named())).groupBy("kind", "value")
                .agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).join(contexts, ["kind", "value"]))
    # an entity seen in fewer texts and contexts has no term with that support
    entities = saved(entities.where(F.greatest("texts", "contexts") >= support).select("kind", "value", "n_e"), "known")
    named = (texts.select("key", "copies", F.inline(_named())).join(small_or_plain(entities, 64), ["kind", "value"], "left_semi")
             .groupBy("key", "copies").agg(F.collect_list(F.struct("kind", "value")).alias("e")))
    close = (near.select("kind", "value", "context", F.explode("terms.term").alias("term")).distinct()
             .groupBy("kind", "value", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support))
    close = saved(close, "close-terms")
    # a term of fewer texts, that is not near an entity often enough either, can make no pair
    held = saved(texts.select("key", "terms").join(named.select("key"), "key").select("key", F.explode("terms").alias("term")), "held-terms")
    enough = (held.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("term")
              .unionByName(close.select("term")).distinct())
    held = held.join(enough, "term").groupBy("key").agg(F.collect_list("term").alias("terms"))
    both = (held.join(named, "key").select("copies", "terms", F.inline("e"))
            .select("kind", "value", "copies", F.explode("terms").alias("term"))
            .groupBy("kind", "value", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts")))
    both = (both.join(close, ["kind", "value", "term"], "left")
            .withColumn("support", F.greatest("texts", "contexts")).where(F.col("support") >= support))
    both = saved(both.select("kind", "value", "term", "n_et", "support"), "shared-terms")
    wanted = both.select("term").distinct()
    terms = (docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
             .join(wanted, "term"))
    ic = -F.log2(F.col("n_e") / F.lit(n_docs))
    pmi = F.log2(F.lit(float(n_docs)) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    return (both.join(terms, "term").join(entities, ["kind", "value"])
            .select("kind", "value", "term", "support", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)).alias("disclosure")))


def personal_data(docs: DataFrame, context: int = CONTEXT, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """One row a document: doc_id, key, spans (base entities) and term_spans
    (terms that give away an entity of the document), both as
    array<struct<start, kind, end, s>>; positions are code points, end exclusive.

    Defined cases: null and empty texts have no spans; base spans of one kind
    do not overlap, those of two kinds may; a term that overlaps a base span
    is left to it; repeated rows each get a row and count as documents of
    their own, but give one context; texts of any length are searched whole;
    an empty table gives no rows; other columns are not looked at.
    """
    found = saved(scan(docs, context), "entities")
    bad = disclosures(docs, found, support).where(F.col("disclosure") >= threshold)
    bad = saved(bad.groupBy("kind", "value").agg(F.collect_set("term").alias("t")), "disclosing")
    terms = (found.where("near is not null").select("key", F.explode(_named()).alias("e")).distinct().select("key", "e.*")
             .join(bad, ["kind", "value"]).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")))
    places = _found(F.concat(F.lit(" "), "text", F.lit(" ")), _TERM, lambda m: F.array_contains("t", F.lower(m)), F.lit(-1))
    places = F.transform(places, lambda x: F.struct(
        x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end"), F.lower(x["s"]).alias("s")))
    free = _free(places, F.col("spans"))
    return found.select("doc_id", "key", "spans", "text").join(terms, "key", "left").select(
        "doc_id", "key", "spans", F.when(F.col("t").isNotNull(), free).otherwise(F.array().cast(_SPAN)).alias("term_spans"))


def sanitise(docs: DataFrame, remove: bool = False, **how) -> DataFrame:
    """The documents, all their columns, with every span of ``personal_data``
    generalised to its kind in brackets, or removed."""
    p = personal_data(docs, **how).select(F.col("key").alias("__key"), F.array_sort(F.concat("spans", "term_spans")).alias("__s")).dropDuplicates(["__key"])
    p = p.where(F.size("__s") > 0)
    d = docs.withColumn("__k", text_key()).join(p, F.col("__k") == F.col("__key"), "left")
    names = F.array(*[F.lit("" if remove else f"[{k.upper()}]") for k in (*KINDS, "term")])

    text = _between(F.col("text"), F.col("__s"), "", lambda s: F.element_at(names, s["kind"] + 1))
    return d.withColumn("text", F.when(F.col("__s").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    p = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")  # noqa: B023
              for k, kind in enumerate(KINDS)]
    return p.select("doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"),
                    _listed(F.array_sort(F.concat("spans", "term_spans"))).alias("spans"))
