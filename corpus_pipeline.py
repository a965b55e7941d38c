"""The corpus pipeline: documents to training sequences, in stages that are written and read again.

Every stage works on all rows that the one before it kept, and passes their columns on unchanged; the
last gives pieces. Defined cases: null and empty texts have no language and go in the first stage; a
null key passes through; of rows that are equal throughout one stays; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common as c, exact_dedup, jaccard_join, language, packing, quality, queries as q


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is ``und``: no letter, or nothing learned."""
    names = c.fresh(docs, "lang_pred"), c.fresh(docs, "lang_score")
    found = language.identified(docs, q.language_profiles(docs), out=names)
    return found.filter(F.col(names[0]) != language.UNKNOWN).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose quality score is under one half."""
    name = c.fresh(docs, "quality_score")
    model = q.quality_model(docs, q.table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, out=name).filter(F.col(name) >= 0.5).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 on runs of five words join, the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with the ids of each."""
    return packing.packed(docs, q.WORD_TOKENIZER, end_id=1, added=True)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("packing", packing_stage),
]

#: Profiles, a fitted model and a tokenizer decide: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents of ``sf_dir``."""
    docs = q.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = c.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
