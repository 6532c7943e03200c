from __future__ import annotations

import datetime as dt

from fathomline.operators import evidence
from fathomline.streaming import events

START = dt.datetime(2024, 1, 1)
ROWS = [(i, START + dt.timedelta(minutes=17 * i), i % 3, ["view", "signup", "error", "purchase"][i % 4], float(i)) for i in range(200)]
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    df = spark.createDataFrame(ROWS, SCHEMA)
    for k in range(4):
        df.where(f"event_id >= {k * 50} and event_id < {k * 50 + 50}").coalesce(1).write.mode("append").parquet(folder)
    return events.event_stream(spark, folder, 1)


def run(df, mode, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(180)
    return df.sparkSession.table(name)


def test_running_evidence_equals_batch(spark, tmp_path):
    got = run(events.evidence(stream(spark, tmp_path), ["user_id", "event_type"], "value"), "complete", "ev", tmp_path).collect()
    want = {}
    for _, _, u, k, v in ROWS:
        n, best = want.get((u, k), (0, 0.0))
        want[u, k] = (n + 1, max(best, v))
    assert {(r.user_id, r.event_type): (r.observations, r.confidence) for r in got} == want


def test_windows_close_behind_the_watermark(spark, tmp_path):
    source = stream(spark, tmp_path)
    got = run(events.tumbling(source, "6 hours", ["user_id"]), "append", "tumble", tmp_path).collect()
    assert got and all(r.n <= 22 for r in got) and {r.window_start.hour for r in got} <= {0, 6, 12, 18}
    assert run(events.sessions(source, "30 minutes", ["user_id"]), "append", "sess", tmp_path).count() > 0
    assert run(events.once(source, "event_id"), "append", "once", tmp_path).count() == 200


def test_workflow_gates(spark, tmp_path):
    got = run(events.workflow(stream(spark, tmp_path), "user_id", ["signup"], ["error"], ["purchase"]), "append", "flow", tmp_path).collect()
    standing, want = {}, {}
    for i, _, u, k, _ in ROWS:
        standing[u] = True if k == "signup" else False if k == "error" else standing.get(u, False)
        want[i] = standing[u] or k != "purchase"
    assert {r.event_id: r.allowed for r in got} == want


def test_upserts_by_batch_are_replayable(spark, tmp_path):
    state = f"{tmp_path}/state"

    def apply(batch, number):
        from pyspark.sql import functions as F

        rows = evidence.observed(batch, F.col("event_type"), F.col("value"), F.col("event_id"), F.col("ts"))
        old = spark.read.parquet(f"{state}/{number - 1}") if number else None
        evidence.merge_evidence(old, rows).write.mode("overwrite").parquet(f"{state}/{number}")

    events.upsert_batches(stream(spark, tmp_path), apply, f"{tmp_path}/cp").awaitTermination(180)
    rows = spark.read.parquet(f"{state}/3").collect()
    assert {r.fingerprint: r.observations for r in rows} == {k: 50 for k in ("view", "signup", "error", "purchase")}
