"""Lines that sum companies up, values in the order of their first place, and years since a month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import companies, ranked
from .registry import ORDERS_NOW, Tables, query, ts


@query("""
WITH f AS (SELECT l_suppkey, l_returnflag || l_partkey % 20 AS v, min((l_orderkey, l_linenumber, l_partkey)) AS place FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, string_agg(v, ';' ORDER BY place, v) AS "values" FROM f GROUP BY 1
""")
def first_places(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("v", F.concat("l_returnflag", (F.col("l_partkey") % 20).cast("string")))
    return ranked.ordered_distinct(rows, ["l_suppkey"], "v", ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn("values", F.array_join("values", ";"))


@query("""
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'present' WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS m, o_orderdate FROM orders),
y AS (SELECT o_orderkey, CASE WHEN m = 'present' THEN 0.0 WHEN m LIKE '____-__' THEN greatest(0, ((2001 - year(o_orderdate)) * 12 + 12 - month(o_orderdate)) / 12.0::DOUBLE) END AS years FROM o)
SELECT o_orderkey, years::DOUBLE AS years, floor(years + 1e-9)::INT AS whole FROM y
""")
def order_years(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 7
    month = F.when(k == 0, "present").when(k == 1, "soon").when(k != 2, F.date_format("o_orderdate", "yyyy-MM"))
    years = dates.years_since(month, ts(ORDERS_NOW))
    return t.orders.select("o_orderkey", years.alias("years"), dates.whole_years(years).alias("whole"))


@query("""
WITH s AS (SELECT c_custkey AS k, c_custkey % 9 = 0 AS seed, c_custkey % 4 AS d, c_custkey % 3 AS p, c_custkey % 5 = 1 AS fresh, c_custkey % 5 = 2 AS recent, c_custkey * 10 AS age, c_mktsegment AS m FROM customer),
e AS (SELECT o_custkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'CAREER_PAGE' WHEN 1 THEN 'JOB_SEARCH' ELSE 'SEED' END AS reason, o_orderstatus, o_totalprice, o_orderkey, o_orderpriority AS source FROM orders),
t AS (SELECT k, string_agg(reason || ' by ' || source || CASE WHEN o_orderkey % 2 = 0 THEN ' for DE' ELSE '' END, chr(10) ORDER BY o_totalprice DESC, o_orderkey) AS lines FROM (SELECT * FROM e WHERE reason <> 'CAREER_PAGE' AND o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_totalprice DESC, o_orderkey) <= 2) GROUP BY 1)
SELECT s.k AS company_id, coalesce(nullif(concat_ws(chr(10), CASE WHEN seed THEN 'added by hand' END, CASE WHEN d > 0 THEN d || ' openings for data engineers' END, CASE WHEN p > 0 THEN p || ' openings for platforms' END,
  CASE WHEN fresh THEN 'hiring within 48 hours' WHEN recent OR age <= 168 THEN 'hiring within 7 days' END, CASE WHEN m = 'BUILDING' THEN 'named beside A, B, D' END, lines), ''), 'nothing is known yet') AS summary
FROM s LEFT JOIN t ON t.k = s.k
""")
def company_summaries(t: Tables) -> DataFrame:
    """Customers as companies, their orders as events."""
    k, no = F.col("c_custkey"), F.lit(False)
    rows = t.customer.select(
        k.alias("company_id"), (k % 9 == 0).alias("is_seed"), (k % 4).alias("data_roles"), (k % 3).alias("platform_roles"), F.when(k % 5 == 1, 1).otherwise(0).alias("fresh_roles"), F.when(k % 5 == 2, 1).alias("recent_roles"), (k * 10).alias("signal_age_hours"),
        no.alias("india_presence"), F.lit(None).cast("boolean").alias("remote_presence"), no.alias("product_company"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(*map(F.lit, "DBAEB"))).alias("similar_to"),
    )
    i = F.col("o_orderkey")
    events = t.orders.select(
        F.col("o_custkey").alias("company_id"), i.alias("event_id"), F.when(i % 4 == 0, "CAREER_PAGE").when(i % 4 == 1, "JOB_SEARCH").otherwise("SEED").alias("reason"), F.when(F.col("o_orderstatus") == "P", "IGNORED").otherwise("NEW").alias("status"), F.col("o_totalprice").alias("confidence"),
        F.col("o_orderpriority").alias("source"), F.when(i % 2 == 0, "DE").alias("role"),
    )
    return companies.summaries(rows, events, 48)
