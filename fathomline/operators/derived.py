"""Derived tables kept up to date from the keys that a batch touches.

Changes name rows of base tables. Their keys go along the joins by semi-joins:
only jobs with a changed row are rescored, and only companies of jobs whose
score changed, or that changed hands, are refreshed. All functions are pure: a
state is a set of DataFrames, and a batch gives the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranked import checkpointed


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of `changes` in place of those with their keys; rows whose `deleted` is true go."""
    kept = table.join(changes.select(*keys), keys, "left_anti")
    new = changes.where(~F.coalesce(F.col("deleted"), F.lit(False))).select(table.columns)
    return kept.unionByName(new)


def refreshed(table: DataFrame, key: str, dirty: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with all `dirty` keys replaced by `fresh`, the keys whose row is new, gone or different)."""
    others = [c for c in table.columns if c != key]
    row = lambda name: F.struct(*others).alias(name)
    old = table.join(dirty, key, "left_semi")
    both = old.select(key, row("_old")).join(fresh.select(key, row("_new")), key, "full")
    changed = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key)
    return table.join(dirty, key, "left_anti").unionByName(fresh.select(table.columns)), changed


@dataclass
class State:
    """sources (job_id, source_id, status, value), jobs (job_id, company_id), and what derives from them: job_scores, company_scores."""

    sources: DataFrame
    jobs: DataFrame
    job_scores: DataFrame
    company_scores: DataFrame


def score_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """job_id, company_id, open (a source is), n_open, score: the mean value of open sources, in hundredths; jobs without sources are closed."""
    open_ = F.col("status") == "OPEN"
    of = sources.groupBy("job_id").agg(F.count_if(open_).alias("n_open"), F.sum(F.when(open_, F.round(F.col("value") * 100).cast("long"))).alias("_sum"))
    rows = jobs.join(of, "job_id", "left")
    n = F.coalesce("n_open", F.lit(0)).cast("long")
    return rows.select("job_id", "company_id", (n > 0).alias("open"), n.alias("n_open"), F.when(n > 0, F.floor(F.col("_sum") / n)).cast("long").alias("score"))


def score_companies(job_scores: DataFrame) -> DataFrame:
    """company_id, open_jobs, best, total of the companies that have jobs; jobs without a company count for none."""
    return job_scores.where("company_id is not null").groupBy("company_id").agg(F.count_if("open").cast("long").alias("open_jobs"), F.max("score").alias("best"), F.sum("score").alias("total"))


def initial(sources: DataFrame, jobs: DataFrame) -> State:
    scores = score_jobs(jobs, sources)
    return State(sources, jobs, scores, score_companies(scores))


def reconcile_batch(state: State, source_changes: DataFrame, job_changes: DataFrame) -> tuple[State, DataFrame]:
    """(the next state, touched): changes are whole rows with `deleted`, at most one for each key.

    touched has table, n: how many keys were looked at again, and how many of
    them changed. A change that leaves a job's score as it was stops there.
    Null keys match nothing.
    """
    dirty_jobs = checkpointed(source_changes.select("job_id").union(job_changes.select("job_id")).where("job_id is not null").distinct())
    jobs = upserted(state.jobs, job_changes, ["job_id"])
    sources = upserted(state.sources, source_changes, ["job_id", "source_id"])
    fresh = score_jobs(jobs.join(dirty_jobs, "job_id", "left_semi"), sources.join(dirty_jobs, "job_id", "left_semi"))
    job_scores, changed = refreshed(state.job_scores, "job_id", dirty_jobs, fresh)
    changed, job_scores = checkpointed(changed), checkpointed(job_scores)
    # A job that moved makes both its old and its new company dirty.
    owners = [t.join(changed, "job_id", "left_semi").select("company_id") for t in (state.job_scores, job_scores)]
    dirty_companies = checkpointed(owners[0].union(owners[1]).where("company_id is not null").distinct())
    fresh = score_companies(job_scores.join(dirty_companies, "company_id", "left_semi"))
    company_scores, moved = refreshed(state.company_scores, "company_id", dirty_companies, fresh)
    named = lambda name, df: df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
    touched = named("jobs", dirty_jobs).union(named("jobs_changed", changed)).union(named("companies", dirty_companies)).union(named("companies_changed", moved))
    return State(checkpointed(sources), checkpointed(jobs), job_scores, checkpointed(company_scores)), touched

