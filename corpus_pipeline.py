"""The corpus pipeline: toxic documents go, one document of each group of near
duplicates stays, secrets are masked, sources are mixed to target weights and
the result is packed into length buckets.

Each stage takes (spark, docs, sf_dir) and is given all rows its predecessor
kept; all but the last return the columns of ``documents``, with any further
columns that they are given. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.functions.ship import ship
from lattica.llm import chosen_path, mixing, packing, secret_scan, toxicity
from lattica.llm.common import Scratch, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go; labels are learned from as in op1. Null
    and empty texts are scored as a text without words; rows without an id are
    scored and no label is learned from them; repeated rows go or stay together."""
    ship(spark)
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest doc_id stays.
    Null and empty texts and rows without an id all stay; of rows that repeat an
    id and its text one stays."""
    ship(spark)
    return chosen_path.keep_first(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret becomes a mask; all rows stay, null and empty texts
    as they are."""
    ship(spark)
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: null, empty and blank texts not at
    all; null sources are one source; repeated rows stand or fall together."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces with their buckets, batches and padding; a null or empty text
    is one piece of no words."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: A learned score and hashed shingles are not SQL; tests/llm/test_pipeline.py
#: holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
