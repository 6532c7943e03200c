"""Batches, queues, boards and merged counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranked import top


def latest_batch(df: DataFrame, keys: list[str], batch: str, order: list[Column], k: int) -> DataFrame:
    """Of each key at most k rows of its newest batch; rows without a batch are left out.

    The newest batch comes from a partial aggregation, so only its rows are ranked.
    """
    newest = df.groupBy(*keys).agg(F.max(batch).alias(batch))
    return top(df.join(newest, [*keys, batch], "left_semi"), keys, order, k)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation alone; `order` is total within a key. Null keys are one key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in [*order, *rest]))


def within_quota(df: DataFrame, keys: list[str], order: list[Column], quota: Column, name: str = "state") -> DataFrame:
    """Marks the first rows of each key up to its quota as queued, and the others as deferred. A null quota defers all."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.when(place <= quota, "queued").otherwise("deferred"))


def board(df: DataFrame, status: str, stages: dict[str, list[str]], order: list[Column], preview: int = 12) -> DataFrame:
    """stage, rank and the row: the first rows of each stage of a board, with the stage's size. Other statuses aren't shown."""
    stage = F.coalesce(*(F.when(F.col(status).isin(names), F.lit(s)) for s, names in stages.items()))
    rows = df.withColumn("stage", stage).where(F.col("stage").isNotNull())
    sizes = rows.groupBy("stage").agg(F.count("*").alias("stage_size"))
    return top(rows, ["stage"], order, preview, "rank").join(F.broadcast(sizes), "stage")  # a row for each of `stages`, which are given as a dict


def merged_counts(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts from several tables (key, n) side by side for every key that any of them has; 0 where one lacks it.

    All parts go through one aggregation in place of a chain of full joins.
    """
    rows = [df.select(key, *(F.col("n") if p == name else F.lit(0).cast("long").alias(p) for p in parts)).withColumnRenamed("n", name) for name, df in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.groupBy(key).agg(*(F.sum(p).alias(p) for p in parts))


def term_weights(df: DataFrame, keys: list[str], term: str, importance: Column) -> DataFrame:
    """Damped weight of each term: 1.5 * ln(1 + the sum of its importances), to three places, half up."""
    total = df.groupBy(*keys, term).agg(F.sum(importance).alias("total"))
    return total.withColumn("weight", F.round((1.5 * F.log1p(F.col("total").cast("double"))).cast("decimal(20,9)"), 3)).drop("total")


def stuffed(df: DataFrame, keys: list[str], term: str, n: str, base: str, most: int = 7, above: int = 2) -> DataFrame:
    """Terms that occur more than `most` times and over `above` times more than in the text they are held against."""
    return df.where((F.col(n) > most) & (F.col(n) > F.coalesce(F.col(base), F.lit(0)) + above)).select(*keys, term, n)


def preferred_sources(df: DataFrame, keys: list[str], is_api: Column, confidence: str, tie: str, k: int = 3) -> DataFrame:
    """At most k sources of each key: those with an interface first, then by confidence."""
    return top(df, keys, [F.desc(is_api.cast("int")), F.desc_nulls_last(confidence), F.asc(tie)], k, "rank")
