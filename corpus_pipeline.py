"""From raw documents to a training mixture: five stages, each a table.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the columns of
``documents``; the last one returns those of the sampled documents.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty
tables and further columns of any name; what it does with them is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, langid, mixing, neardup, pii
from gleaner.llm.common import materialize
from gleaner.session import apply_defaults
from gleaner.sources.tables import read_table


#: Near-duplicates of the stage: five-word shingles, similarity 0.8 or more. With so many registers per band and so
#: much slack of the estimate (six standard deviations), about one pair in a million at 0.8 itself is missed.
NEAR = {"k": 5, "percent": 80, "width": 6, "slack": 0.16}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters, or mixed beyond half, go."""
    apply_defaults(spark)
    return langid.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id."""
    apply_defaults(spark)
    return neardup.deduplicate(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat a benchmark item in a twentieth of their words."""
    apply_defaults(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in the text."""
    apply_defaults(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens meet the target shares of sources, languages and topics."""
    apply_defaults(spark)
    return mixing.sample(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
]

#: The language model and the pseudo-random sketches are beyond SQL; tests/llm compares the near-duplicate and benchmark stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
