"""The pipeline against the brute-force versions of its stages, one after the
other; the registered queries against their SQL."""
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leverkit.llm import langid, lines, pipeline, queries
from leverkit.llm.common import saved

from .test_operators import DOC, bench_words, brute_components, brute_lines, corpus, space_words, targets


def drop_lines(rows):
    cut = defaultdict(set)
    for d, i, _, _, kept in brute_lines(rows):
        if not kept:
            cut[d].add(i)
    out = []
    for r in rows:
        if r[1] is None or r[0] not in cut:
            out.append(r)
            continue
        left = "\n".join(s for i, s in enumerate(r[1].split("\n")) if i not in cut[r[0]])
        if left.strip(" "):
            out.append((r[0], left, *r[2:4], len(left)))
    return out


def test_identify_language_sends_each_text_once(spark, monkeypatch):
    """The text goes to Python as the operator's own column only, not in the
    row beside it; columns, their order and names stay."""
    docs = spark.createDataFrame([(i, "some words of a text", "en") for i in range(8)], "doc_id long, text string, lang string")
    docs = docs.select("lang", "text", "doc_id", F.lit("mine").alias("lang_pred"))
    sent, plain = [], langid.predict

    def spy(d, model):
        sent.append(d)
        return plain(d, model)
    monkeypatch.setattr(langid, "predict", spy)
    got = pipeline.identify_language(spark, docs, "")
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [("en", "some words of a text", i, "mine") for i in range(8)]
    assert got.columns == docs.columns
    assert str(sent[0].schema.jsonValue()).count("'text'") == 1


def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus(11, 40) if r[0] not in (None, 105)]
    rows = list({r[0]: r for r in rows}.values())  # one row an id: the brute force goes by id
    items = [(1, " ".join(bench_words(rows[4][1])[1:16])), (2, None)]
    docs = spark.createDataFrame(rows, DOC)
    docs.withColumn("score", F.lit("mine")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # language ID: the operator's own predictions decide
    pred = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs.where(langid.id_hash(4) != 2))).collect()}
    rows = [(r[0], r[1], r[2] or pred[r[0]].lang_pred, *r[3:]) for r in rows
            if pred[r[0]].lang_pred != "und" and pred[r[0]].score >= pipeline.LEAST_SCORE]
    got = pipeline.identify_language(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and {r.score for r in got.collect()} == {"mine"}
    assert {(r.doc_id, r.lang) for r in got.collect()} == {(r[0], r[2]) for r in rows}
    rows = drop_lines(rows)
    keep = {c for d, n, c in brute_components(rows) if n} | {d for d, n, _ in brute_components(rows) if not n}
    rows = [r for r in rows if r[0] in keep]
    grams = {tuple(bench_words(items[0][1])[i:i + 13]) for i in range(len(bench_words(items[0][1])) - 12)}

    def contaminated(text):
        w = bench_words(text)
        hit = {p for s in range(len(w) - 12) if tuple(w[s:s + 13]) in grams for p in range(s, s + 13)}
        return len(hit) > 0 and 20 * len(hit) >= len(w)
    rows = [r for r in rows if not contaminated(r[1])]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(space_words(r[1]))
    want = targets(sizes)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r for r in rows}
    taken = Counter()
    for r in got:
        assert (r.text, r.lang, r.source, r.n_chars) == texts[r.doc_id][1:] or r.text == texts[r.doc_id][1]
        assert 0 < r.taken <= 3 * len(space_words(r.text)) and math.isclose(r.target, want[r.source])
        taken[r.source] += r.taken
    assert taken == Counter({s: math.floor(t + 0.5) for s, t in want.items()})


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "line", "ngram", "decontamination", "mixing"]


def near_copies():
    """A text; it with 2 of 100 words changed (0.81 by five-word shingles, 0.88
    by three-word ones) and with 15 words added (0.86, 0.87); it with 3 words
    changed (0.73); and another text."""
    base = [f"w{i}" for i in range(100)]
    change = lambda at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    texts = [change([]), change([30, 60]), " ".join(base + [f"y{i}" for i in range(15)]), change([20, 50, 80]), "something else"]
    return [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]


def test_near_copy_stage_links_from_four_fifths(spark, tmp_path):
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(near_copies(), DOC), str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 3, 4}


def test_no_exact_copy_survives(spark, sf):
    """Of documents alike in text, one at most is left after the two stages,
    short lines or not."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    first, later = {}, set()
    for i, t in sorted(rows):
        if t and any(len(s.strip(" ")) >= lines.MIN_EXACT for s in t.split("\n")):
            if t in first:
                later.add(i)
            first.setdefault(t, i)
    left = pipeline.drop_near_copies(spark, saved(pipeline.dedup_lines(spark, docs, sf)), sf)
    kept = {r.doc_id for r in left.select("doc_id").collect()}
    assert len(later) > 50 and not later & kept
    assert len(kept) > 0.8 * len(first)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    assert Counter(map(norm, cur.fetchall())) == Counter(norm(r) for r in df.select(*cols).collect())
