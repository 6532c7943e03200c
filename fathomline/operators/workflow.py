"""Applications: gated transitions, automatic recommendation, and leases of runs, as functions of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .funnel import approved

PREPARATION = ["DISCOVERED", "ANALYZED", "RECOMMENDED", "RESUME_GENERATED", "USER_REVIEW"]
APPROVAL = ["APPROVED", "READY_TO_APPLY", "APPLICATION_STARTED"]
OUTCOMES = ["APPLIED", "OA", "RECRUITER_SCREEN", "TECHNICAL", "FINAL", "OFFER"]
CLOSED = ["REJECTED", "WITHDRAWN"]


def check_transitions(requests: DataFrame, applications: DataFrame, events: DataFrame) -> DataFrame:
    """Each request (application_id, to_status) with from_status and problem, which is null where it is allowed.

    Whatever follows approval needs one that stands: by the current status, or by
    the last decisive event.
    """
    decided = approved(events, "application_id", ["created_at"], F.col("to_status") == "APPROVED", (F.col("to_status") == "USER_REVIEW") & F.col("from_status").isin(*APPROVAL))
    rows = requests.join(applications.select("application_id", F.col("status").alias("from_status")), "application_id", "left").join(decided, "application_id", "left")
    stands = F.col("from_status").isin(*APPROVAL, *OUTCOMES) | F.coalesce("approved", F.lit(False))
    gated = F.col("to_status").isin(*APPROVAL[1:], *OUTCOMES)
    problem = F.when(F.col("from_status").isNull(), "unknown application").when(~F.col("to_status").isin(*PREPARATION, *APPROVAL, *OUTCOMES, *CLOSED), "unknown status").when(gated & ~stands, "not approved")
    return rows.withColumn("problem", problem).drop("approved")


def sync_recommendations(jobs: DataFrame, applications: DataFrame, last_actor: DataFrame) -> DataFrame:
    """Events that bring applications in line with what is recommended now.

    `jobs` has job_id and priority_class; applications job_id and status;
    `last_actor` job_id and actor of the last event. What a user did is never
    undone, and what the system withdrew may be recommended again.
    """
    rows = jobs.join(applications, "job_id", "left").join(last_actor, "job_id", "left")
    wanted = F.col("priority_class") != "REJECT"
    to = (
        F.when(wanted & F.col("status").isNull(), "RECOMMENDED")
        .when(wanted & (F.col("status") == "WITHDRAWN") & (F.col("actor") == "system"), "RECOMMENDED")
        .when(wanted & F.col("status").isin("DISCOVERED", "ANALYZED"), "RECOMMENDED")
        .when(~wanted & F.col("status").isin(*PREPARATION), "WITHDRAWN")
    )
    return rows.select("job_id", F.col("status").alias("from_status"), to.alias("to_status"), F.lit("system").alias("actor")).where("to_status is not null")


def variant_status(old: Column, newer: Column) -> Column:
    """A resume version that a newer one replaces: reviewed ones are superseded, approved ones stale."""
    return F.when(newer & (old == "USER_REVIEW"), "SUPERSEDED").when(newer & (old == "APPROVED"), "STALE").otherwise(old)


def recover_leases(runs: DataFrame, now: Column) -> DataFrame:
    """Runs whose lease ran out go back to the queue, or fail after their last attempt."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") < now)
    status = F.when(lost & (F.col("attempts") >= F.col("max_attempts")), "FAILED").when(lost, "QUEUED").otherwise(F.col("status"))
    return runs.withColumns({"lease_owner": F.when(~lost, F.col("lease_owner")), "status": status})


def claimable(runs: DataFrame, now: Column) -> Column:
    return (F.col("status") == "QUEUED") & (F.col("not_before").isNull() | (F.col("not_before") <= now))


def query_split(budget: Column) -> Column:
    """struct of a query budget's parts: a fifth kept back, then 60 and 25 per cent, then the rest."""
    free = budget - F.ceil(budget * 0.2)
    first, second = F.ceil(free * 0.6), F.floor(free * 0.25)
    return F.struct((budget - free).alias("reserve"), first.alias("search"), second.alias("signals"), (free - first - second).alias("similar"))
