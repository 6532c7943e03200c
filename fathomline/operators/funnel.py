"""Funnels over event histories, and status rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import percent


def reached(events: DataFrame, key: str, status: str, stages: dict[str, list[str]]) -> DataFrame:
    """Per key, for each named set of statuses, whether one of them was ever reached."""
    return events.groupBy(key).agg(*(F.coalesce(F.bool_or(F.col(status).isin(*names)), F.lit(False)).alias(n) for n, names in stages.items()))


def totals(rows: DataFrame, applied: str, response: str, interview: str, offer: str) -> DataFrame:
    """One row of counts; a rate over nobody is null."""
    out = rows.agg(
        F.count("*").alias("tracked"),
        F.count_if(applied).alias("applied"),
        *(F.count_if(F.col(applied) & F.col(c)).alias(n) for n, c in (("responses", response), ("interviews", interview), ("offers", offer))),
    )
    return out.withColumn("interview_rate", percent(F.col("interviews"), F.col("applied")))


def breakdown(rows: DataFrame, dimensions: dict[str, Column], applied: str, response: str, interview: str, least: int = 5) -> DataFrame:
    """Applications, responses and interviews by the values of several dimensions, in one aggregation.

    A dimension may be an array, of which each element counts. Null and empty
    values are UNKNOWN. Groups below `least` applications are flagged.
    """
    arrays = {n: c if str(rows.select(c.alias("c")).schema["c"].dataType).startswith("Array") else F.array(c) for n, c in dimensions.items()}

    def labelled(name: str, values: Column) -> Column:
        values = F.coalesce(values.cast("array<string>"), F.array(F.lit(None).cast("string")))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), F.coalesce(F.nullif(v, F.lit("")), F.lit("UNKNOWN")).alias("value")))

    pairs = [labelled(name, values) for name, values in arrays.items()]
    long = rows.where(F.col(applied)).select(applied, response, interview, F.explode(F.concat(*pairs)).alias("d"))
    groups = long.groupBy("d.dimension", "d.value").agg(F.count("*").alias("applications"), F.count_if(response).alias("responses"), F.count_if(interview).alias("interviews"))
    return groups.withColumns({"interview_rate": percent(F.col("interviews"), F.col("applications")), "low_sample": F.col("applications") < least})


def approved(events: DataFrame, key: str, order: list[str], grants: Column, revokes: Column) -> DataFrame:
    """Whether the last decisive event of each key was a grant; keys without one are not approved."""
    last = F.max(F.when(grants | revokes, F.struct(*order, grants.alias("granted")))).alias("_last")
    return events.groupBy(key).agg(last).select(key, F.coalesce("_last.granted", F.lit(False)).alias("approved"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def rollup(df: DataFrame, status: str, subsets: dict[str, list[str]]) -> DataFrame:
    """One row with the number of rows in each set of statuses."""
    return df.agg(*(F.count_if(F.col(status).isin(*names)).alias(n) for n, names in subsets.items()))
