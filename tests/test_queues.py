from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import queues


def test_only_the_newest_batch_counts(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4), ("c", None, 5)], "k string, batch int, id int")
    out = queues.latest_batch(df, ["k"], "batch", [F.asc("id")], 1)
    assert sorted((r.k, r.id) for r in out.collect()) == [("a", 2), ("b", 4)]


def test_first_seen_takes_null_keys_as_one(spark):
    df = spark.createDataFrame([(None, 2, "y"), (None, 1, "x"), ("a", 3, None)], "k string, at int, v string")
    assert {tuple(r) for r in queues.first_seen(df, ["k"], ["at"]).collect()} == {(None, 1, "x"), ("a", 3, None)}


def test_quota_defers_the_rest(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, None)], "k string, id int, q int")
    out = queues.within_quota(df, ["k"], [F.desc("id")], F.col("q"))
    assert sorted((r.k, r.id, r.state) for r in out.collect()) == [("a", 1, "deferred"), ("a", 2, "queued"), ("b", 1, "deferred")]


def test_board_shows_known_statuses(spark):
    df = spark.createDataFrame([(1, "O"), (2, "O"), (3, "?"), (4, None)], "id int, s string")
    out = queues.board(df, "s", {"open": ["O"]}, [F.asc("id")], 1)
    assert [(r.stage, r.id, r["rank"], r.stage_size) for r in out.collect()] == [("open", 1, 1, 2)]


def test_merged_counts_keep_keys_of_any_table(spark):
    a, b = (spark.createDataFrame(rows, "k string, n long") for rows in ([("x", 2), (None, 1)], [("x", 3), ("y", 4)]))
    out = queues.merged_counts({"a": a, "b": b}, "k")
    assert {tuple(r) for r in out.collect()} == {("x", 2, 3), (None, 1, 0), ("y", 0, 4)}


def test_stuffed_needs_both_limits(spark):
    df = spark.createDataFrame([(1, "a", 8, 5), (1, "b", 8, 6), (1, "c", 7, None), (1, "d", 8, None)], "doc int, w string, n int, base int")
    assert {r.w for r in queues.stuffed(df, ["doc"], "w", "n", "base").collect()} == {"a", "d"}
