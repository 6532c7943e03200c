"""The corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, media, mixing, neardup, negatives, packing, passages, private, quality, secret_scan, topk, urls
from .common import read


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text stored as an image and read back: sizes, hashes, a difference hash and the NPY tile. Null texts count as empty."""
    return media.text_media(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans of each document. Null texts count as empty; each row gives one."""
    found = private.personal_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*private.BASE_KINDS))
    return found.select(
        "doc_id",
        *(private.count_of(k).alias(f"n_{k}") for k in private.BASE_KINDS),
        F.sha2(private.joined(base), 256).alias("base_sha256"),
        private.joined("spans").alias("spans"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans of each document. Null texts count as empty; each row gives one."""
    found = secret_scan.secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        "doc_id",
        *(private.count_of(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.sha2(private.joined(base), 256).alias("base_sha256"),
        private.joined("spans").alias("spans"),
    )


QUERIES = {
    "op1_mixing": mixing.query,
    "op2_packing": packing.query,
    "op4_url_filter": urls.query,
    "op3_near_dedup": neardup.query,
    "op5_quality": quality.query,
    "op6_media": op6_media,
    "op7_fingerprints": fingerprints.query,
    "op8_pii": op8_pii,
    "op9_repeats": passages.query,
    "op10_secrets": op10_secrets,
    "op11_alignment": alignment.query,
    "op12_hard_negatives": negatives.query,
    "op13_exact_topk": topk.query,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op4_url_filter": urls.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_exact_topk": topk.ORACLE,
}
