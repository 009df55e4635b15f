"""From raw documents to a training mixture: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialweave.llm.common import stage, table
from trialweave.llm.decontaminate import decontaminate
from trialweave.llm.jaccard import deduplicate
from trialweave.llm.language import keep_identified
from trialweave.llm.mixing import sample
from trialweave.llm.privacy import sanitise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, no letters) go."""
    return keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id."""
    return deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; n_chars follows."""
    return sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights, with each document's probability as mix_p."""
    return sample(docs)


STAGES = [
    ("language", identify_language),
    ("near duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("mixture", mixed),
]

#: Language prediction and similarity classes cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
