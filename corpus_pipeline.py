"""The corpus pipeline: five filters and transforms over ``documents``, each written and reread.

``STAGES`` lists the stages in order as ``(name, function)``; a function takes
``(spark, docs, sf_dir)`` and returns the documents it keeps, with their columns
(the last stage returns the index of the written tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeskel.llm import decontam, mixing, neardup, tokens, toxicity
from codeskel.llm.common import cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled examples do not call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources meet their target weights; repeated ones appear repeatedly."""
    return mixing.expand(mixing.mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, written and read back: one row per document."""
    return tokens.read_index(tokens.write_tokens(docs, tokens.default_tokenizer()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: No SQL: the stages learn, hash and tokenize; tests/llm/test_pipeline.py works the result out by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
