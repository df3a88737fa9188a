"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it again.  All stages but the last return the columns of
``documents``, further ones included; private columns get names that those do not have.

Nulls and odd rows: a null or letterless text goes in language ID; a null lang is not learned from; a null source or
n_chars passes.  Rows are judged as rows: a null doc_id, or one that repeats, changes no decision.  Of equal rows one stays
(near-duplicates).  Whole texts count, however long.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, fresh, load
from plumbline.llm.near_copies import without_near_copies
from plumbline.llm.op01_language_masks import identify, train
from plumbline.llm.op04_multi_bwt import removed_ranges, without_ranges
from plumbline.llm.op06_benchmark_leaks import decontaminated
from plumbline.llm.op09_linear_grouping import pack_documents

#: Share of a text's n-grams that its language must contain; prose of a learned language is far above.
LEAST_COVERAGE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are written in a language of the corpus; letterless and unreadable ones go."""
    lang, score, coverage = (fresh(docs.columns, c) for c in ("lang_pred", "score", "coverage"))
    found = identify(docs, train(docs), (lang, score, coverage))
    return found.filter((F.col(lang) != "und") & (F.col(coverage) >= LEAST_COVERAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more.

    Of a group the row of the smallest doc_id stays (rows without one come last, then the text's hash decides); rows that
    are equal in all columns leave one.
    """
    return without_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; what is left of a cut character goes, too."""
    return without_ranges(docs, removed_ranges(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every row is judged by its own text, with or without an id."""
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: SQL cannot express the learned and the fingerprint stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
