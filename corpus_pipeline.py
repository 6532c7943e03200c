"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before it kept, and is written as
Parquet and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import mixing, neardup, packing, quality, secret_scan
from fathomline.llm.common import Shelf, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking, learnt from the labelled ones, rejects go."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more the smallest id stays."""
    return neardup.keep_one(docs, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at their source's rate, and shuffled."""
    return mixing.poisson_mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, placed in sequences of 2048."""
    return packing.production(docs, with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can't express a learnt ranking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf, before = read(spark, sf_dir, "documents"), Shelf(spark, "pipeline"), []
    for name, stage in STAGES:
        docs = shelf.put(name, stage(spark, docs, sf_dir))
        shelf.drop(*before)
        before = [name]
    return docs
