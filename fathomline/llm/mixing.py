"""Mixing sources to target weights by Poisson replication.

Each document draws its number of copies from a Poisson distribution whose mean
is its source's target repetition rate. The draw inverts the distribution at a
hash of the document's id, so it is the same on every run and every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_share, read

#: Up to so many sources are broadcast with their distributions; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
SEED = 17
#: A source's weight is its number of documents to this power, where no weights are given.
ALPHA = 0.7


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    return (_number(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 13) + F.lit(0.5)) / F.lit(float(2**52))


def _distribution(rate: Column) -> Column:
    """P(copies <= k) for k = 0, 1, ... as far as a double tells it from 1; logarithms keep large rates exact."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"), F.concat(s["all"], F.array(s["sum"] + F.exp(log))).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])).otherwise(F.array(F.lit(1.0)))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, by: str = "source", id_col: str = "doc_id", seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Copies of the rows of `docs`, so that sources stand to each other as their weights.

    `weights` has the columns `by` and weight; sources that it lacks get none. By
    default a source weighs its number of documents to the power `alpha`. `total`
    documents are expected (default: as many as there are). Returns the columns
    of `docs`, copy (1, 2, ...) and shuffle_key, by which all copies are shuffled.
    A null source is a source of its own; null ids share one draw; repeated rows
    are each copied as often. Without documents the result is empty. Columns of
    `docs` that are named copy or shuffle_key are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    source, rate_, below, draw, copies_ = (f"__mix_{n}" for n in ("source", "rate", "below", "draw", "copies"))
    sizes = docs.groupBy(F.col(by).alias(source)).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col(by).alias("given")).agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col(source).eqNullSafe(F.col("given")), "left").drop("given").fillna(0.0, ["weight"])
    kinds, n, mass = sizes.agg(F.count("*"), F.sum("n"), F.sum("weight")).first()
    rate = F.lit(float(total if total is not None else n or 0)) * F.col("weight") / F.lit(mass or 1.0) / F.col("n")
    rates = sizes.withColumn(rate_, rate).select(source, _distribution(F.col(rate_)).alias(below))
    if kinds <= BROADCAST_SOURCES:
        drawn = docs.join(F.broadcast(rates), F.col(by).eqNullSafe(F.col(source)))
    else:  # most sources are shuffled, the largest aren't
        tag = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
        tagged = sizes.select(tag(source).alias(source), "n", _distribution(rate).alias(below))
        drawn = join_by_share(docs.withColumn(source, tag(by)), tagged, [source], "n", n)
    drawn = drawn.withColumn(draw, uniform(seed, F.col(id_col)))
    drawn = drawn.withColumn(copies_, F.size(F.filter(below, lambda p: p <= F.col(draw))))
    copies = drawn.where(F.col(copies_) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies_).cast("long"))).alias("copy"))
    key = _number(F.concat_ws(":", F.lit(seed).cast("string"), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")), 15)
    copies = copies.withColumn("shuffle_key", key)
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents by the default weights of their sources; poisson_mix says what holds for odd rows."""
    return poisson_mix(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
u AS (SELECT *, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2, 52) AS u FROM documents),
d AS (SELECT u.doc_id, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.below <= u.u GROUP BY u.doc_id),
e AS (SELECT doc_id, unnest(generate_series(1, copies)) AS copy FROM d)
SELECT documents.*, copy, ('0x' || substr(md5('{SEED}:order:' || e.doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM e JOIN documents USING (doc_id)
"""
