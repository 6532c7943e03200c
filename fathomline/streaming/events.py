"""Evidence, windows and workflow over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import TimestampType


def event_stream(spark: SparkSession, folder: str, files_at_a_time: int = 64) -> DataFrame:
    """The `events` files of a folder as a stream; ts becomes a zoned timestamp, as watermarks need."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast(TimestampType()))


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Repeated deliveries of an event within the watermark are dropped; the state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def evidence(events: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Running evidence of each key: count, highest confidence, first and last time. Update or complete mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("observations"), F.max(confidence).alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def tumbling(events: DataFrame, length: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _windowed(events.withWatermark("ts", late), F.window("ts", length), keys)


def sliding(events: DataFrame, length: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _windowed(events.withWatermark("ts", late), F.window("ts", length, step), keys)


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return _windowed(events.withWatermark("ts", late), F.session_window("ts", gap), keys)


def _windowed(events: DataFrame, window, keys: list[str]) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def workflow(events: DataFrame, key: str, grants: list[str], revokes: list[str], gated: list[str]) -> DataFrame:
    """Each event with whether its transition is allowed: gated types need an approval that stands.

    The state of a key is one flag. Within a batch events are taken in order of time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        standing = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for kind in rows["event_type"]:
            standing = True if kind in grants else False if kind in revokes else standing
            allowed.append(standing or kind not in gated)
        state.update((bool(standing),))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "event_type": rows["event_type"], "allowed": allowed})

    kind = dict(events.dtypes)[key]
    rows = events.select(key, "event_id", "event_type", "ts")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, event_type string, allowed boolean", "standing boolean", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, apply, checkpoint: str):
    """Start micro-batches that hand each batch to `apply(batch, batch_id)`, which must be idempotent by its id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
