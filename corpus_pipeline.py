"""A training corpus from raw documents: quality rules, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of ``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.near_duplicates import one_of_each
from leafmill.llm.packing import pack
from leafmill.llm.personal_data import redact
from leafmill.llm.quality import cleaned
from leafmill.session import durable

#: Near-duplicates of the corpus: 100 * intersection >= NEAR_PERCENT * union of the sets of shingles.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, without the lines that their host repeats, unless that depletes them."""
    return cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near-duplicates (similarity of at least 0.8)."""
    return one_of_each(docs, NEAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their ids."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL has neither the trees' fit nor the tokenizer; tests/llm compares with a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
