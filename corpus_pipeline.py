"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, which have the columns
of ``documents``, and returns a DataFrame; all but the last return those columns. A stage's
result is written as Parquet and reread as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumic.llm import decontamination, mixing, neardup, pii, quality_rules
from vellumic.scratch import Scratch

#: Documents of which five-word shingles agree to at least this part, in percent, are one group.
SIMILARITY = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.quality_filter(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 80 percent or more stays, that of the least id."""
    return neardup.near_duplicate_filter(docs, percent=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets; ``n_chars`` follows."""
    return pii.pii_mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document (see ``vellumic.llm.mixing``)."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal data", mask_personal_data),
    ("mixing", mix),
]

#: Chosen paths, substitution-tolerant verification and context scores are not expressed in
#: SQL here; the tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
