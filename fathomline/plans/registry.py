"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The moment at which orders and events are looked at.
ORDERS_NOW = "2001-12-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ts(literal: str) -> Column:
    return F.lit(literal).cast("timestamp_ntz")


def cents(column: str) -> Column:
    """Money as a decimal, whose sums do not depend on their order."""
    return F.col(column).cast("decimal(18,2)")
