"""The corpus pipeline: language ID, line dedup, near-copy removal,
decontamination, mixing.  Each stage works on all that the one before kept;
between stages the documents are written and read again."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverkit.llm import decontaminate, jaccard, langid, lines, mixing
from leverkit.llm.common import saved, table

#: a text whose predicted language has fewer of its n-grams than this is rejected
LEAST_SCORE = 0.5


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts of which no language has half
    the n-grams; fills in a missing ``lang``."""
    model = langid.learn(docs.where(langid.id_hash(4) != 2))
    # the other columns go along as one value, so their names cannot clash
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    d = langid.predict(docs.select("text", rest.alias("__row")), model)
    kept = d.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    kept = kept.select("__row.*", "text", F.col("lang_pred").alias("__lang"))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that came before; drops documents of which nothing is left."""
    return lines.dedup_lines(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: five-word shingles,
    four fifths of them shared (op5's own contract is stricter)."""
    return jaccard.drop_near_copies(docs, shingle=5, num=80, den=100)


def decontaminate_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix),
]
#: edit distance, trained filters and components of near copies are not stated in SQL
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs, name)
    return docs
