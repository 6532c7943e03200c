"""Batches, queues, boards and merged counts over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import queues
from .registry import Tables, query

BOARD = {"saved": ["O"], "applied": ["P"], "closed": ["F", "X"]}


@query("""
WITH e AS (SELECT *, ts::DATE AS batch, max(ts::DATE) OVER (PARTITION BY user_id) AS newest FROM events)
SELECT user_id, event_id, batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM e WHERE batch = newest) WHERE k <= 50
""")
def latest_batch(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "value", F.to_date("ts").alias("batch"))
    return queues.latest_batch(rows, ["user_id"], "batch", [F.desc("value"), F.asc("event_id")], 50).select("user_id", "event_id", "batch")


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_seen(t: Tables) -> DataFrame:
    return queues.first_seen(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= o_custkey % 4 THEN 'queued' ELSE 'deferred' END AS state FROM orders
""")
def within_quota(t: Tables) -> DataFrame:
    return queues.within_quota(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], F.col("o_custkey") % 4).select("o_orderkey", "state")


@query("""
WITH s AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'saved' WHEN 'P' THEN 'applied' WHEN 'F' THEN 'closed' END AS stage FROM orders),
r AS (SELECT stage, o_orderkey, row_number() OVER (PARTITION BY stage ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY stage) AS stage_size FROM s WHERE stage IS NOT NULL)
SELECT * FROM r WHERE rank <= 12
""")
def stage_board(t: Tables) -> DataFrame:
    out = queues.board(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", BOARD, [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return out.select("stage", "o_orderkey", F.col("rank").cast("long").alias("rank"), "stage_size")


@query("""
WITH a AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM a FULL JOIN b USING (nation)
""")
def merged_counts(t: Tables) -> DataFrame:
    of = lambda df, key: df.groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n"))
    return queues.merged_counts({"customers": of(t.customer, "c_nationkey"), "suppliers": of(t.supplier, "s_nationkey")}, "nation")


@query("""
SELECT l_suppkey, l_returnflag, round((1.5 * ln(1 + sum(l_linenumber)))::DECIMAL(20, 9), 3)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2
""")
def term_weights(t: Tables) -> DataFrame:
    return queues.term_weights(t.lineitem, ["l_suppkey"], "l_returnflag", F.col("l_linenumber").cast("long")).withColumn("weight", F.col("weight").cast("double"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
b AS (SELECT word, max(n) AS base FROM (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark) GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, word, n FROM c LEFT JOIN b USING (word) WHERE n > 7 AND n > coalesce(base, 0) + 2
""")
def stuffed_terms(t: Tables) -> DataFrame:
    """Words of a document that occur much more often than in any benchmark passage."""
    count = lambda df, key: df.select(key, F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''").groupBy(key, "word").agg(F.count("*").alias("n"))
    base = count(t.benchmark, "item_id").groupBy("word").agg(F.max("n").alias("base"))
    return queues.stuffed(count(t.documents, "doc_id").where("n > 7").join(base, "word", "left"), ["doc_id"], "word", "n", "base")


@query("""
SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25)::INT DESC, p_retailprice DESC NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 3
""")
def preferred_sources(t: Tables) -> DataFrame:
    return queues.preferred_sources(t.part, ["p_brand"], F.col("p_size") > 25, "p_retailprice", "p_partkey").select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))
