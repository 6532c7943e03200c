"""Versions of texts, and tables kept up to date by what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derived, versions
from .registry import Tables, query


@query()
def version_likeness(t: Tables) -> DataFrame:
    """Each document and the next one of its source: whether they are the same text by words, and what decided that."""
    pairs = versions.consecutive(t.documents, "source", "doc_id", "text")
    return versions.compare_versions(pairs, "old", "new").select("source", "doc_id", "next", "decided", "ratio", "same")


@query("""
WITH d AS (SELECT DISTINCT source, doc_id FROM documents WHERE doc_id IS NOT NULL)
SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM d
""")
def following_ids(t: Tables) -> DataFrame:
    return versions.following(t.documents, "source", "doc_id", 256)


def listings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as sources of jobs, orders as jobs, customers as companies."""
    sources = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("source_id")).agg(F.max(F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("CLOSED")).alias("status"), F.max("l_extendedprice").alias("value"))
    return sources, t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"))


def batch(sources: DataFrame, jobs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What the k-th scan finds: one order in 40 has other lines, one in 60 another customer, and a few are gone."""
    lines = sources.where(F.col("job_id") % 40 == k).withColumns({"status": F.when(F.col("source_id") % 2 == k % 2, "CLOSED").otherwise("OPEN"), "value": F.col("value") + k, "deleted": F.col("source_id") % 5 == k})
    orders = jobs.where(F.col("job_id") % 60 == k).withColumns({"company_id": F.col("company_id") + 1, "deleted": F.col("job_id") % 240 == k})
    return lines, orders


_CHANGED = """
WITH s AS (SELECT l_orderkey AS job_id, l_linenumber AS source_id, max(CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END) AS status, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
c AS (SELECT job_id, CASE WHEN job_id % 40 NOT IN (1, 2, 3) THEN status WHEN source_id % 2 = job_id % 40 % 2 THEN 'CLOSED' ELSE 'OPEN' END AS status, CASE WHEN job_id % 40 IN (1, 2, 3) THEN value + job_id % 40 ELSE value END AS value
      FROM s WHERE NOT (job_id % 40 IN (1, 2, 3) AND source_id % 5 = job_id % 40)),
j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 60 IN (1, 2, 3) THEN o_custkey + 1 ELSE o_custkey END AS company_id FROM orders WHERE o_orderkey % 240 NOT IN (1, 2, 3)),
x AS (SELECT job_id, company_id, count(*) FILTER (status = 'OPEN') AS n_open, sum(round(value * 100)::BIGINT) FILTER (status = 'OPEN') AS total FROM j LEFT JOIN c USING (job_id) GROUP BY 1, 2),
y AS (SELECT *, n_open > 0 AS open, CASE WHEN n_open > 0 THEN floor(total / n_open)::BIGINT END AS score FROM x)"""


def after_batches(t: Tables, n: int = 3) -> tuple[derived.State, list[DataFrame]]:
    sources, jobs = listings(t)
    state, touched = derived.initial(sources, jobs), []
    for k in range(1, n + 1):
        state, seen = derived.reconcile_batch(state, *batch(sources, jobs, k))
        touched.append(seen.withColumn("batch", F.lit(k)))
    return state, touched


@query(f"{_CHANGED} SELECT job_id, company_id, open, n_open, score FROM y")
def reconciled_jobs(t: Tables) -> DataFrame:
    """Scores of all jobs after three batches, of which each rescored only what it touched."""
    return after_batches(t)[0].job_scores


@query(f"{_CHANGED} SELECT company_id, count(*) FILTER (open) AS open_jobs, max(score) AS best, sum(score)::BIGINT AS total FROM y GROUP BY 1")
def reconciled_companies(t: Tables) -> DataFrame:
    return after_batches(t)[0].company_scores


@query("""
WITH o AS (SELECT o_orderkey AS k FROM orders), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT b AS batch, count(DISTINCT k) AS n FROM (SELECT unnest([1, 2, 3]) AS b), (SELECT k, 60 AS m FROM o UNION ALL SELECT k, 40 FROM l) WHERE k % m = b GROUP BY 1
""")
def reconciled_counts(t: Tables) -> DataFrame:
    """How many jobs each batch looked at again."""
    first, *others = after_batches(t)[1]
    for more in others:
        first = first.unionByName(more)
    return first.where(F.col("table") == "jobs").select(F.col("batch").cast("int").alias("batch"), "n")
