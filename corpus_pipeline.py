"""Corpus pipeline: toxicity, near copies, repeated passages, benchmark passages, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
table. ``run`` writes each result to the shared folder and reads it back, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loadloom.llm import decontaminate, near_copies as copies, packing, substring, toxicity
from loadloom.llm.common import read
from loadloom.sources.stage import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows of these, does not reject."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return copies.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 and more words that occur more than once."""
    return substring.without_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or too little of one to count."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", civil),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", unrepeated),
    ("benchmark_decontamination", uncontaminated),
    ("best_fit_packing", sequences),
]

# Fingerprints, trained scores and tokens have no SQL form; the tests use a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
