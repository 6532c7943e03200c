"""State changes over orders, customers, suppliers and events: upserts, reviews, scans and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import listing, state
from .registry import ORDERS_NOW, Tables, query, ts

def _i() -> Column:
    return F.col("o_orderkey")



@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority AS title, o_orderstatus AS location, 'x' || o_custkey % 5 AS salary, CASE o_orderkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'unknown' END AS remote_status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS posted_at FROM orders),
n AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'new ' || title END AS t2, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' END AS l2, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'onsite' END AS r2, TIMESTAMP '2001-01-01' AS p2 FROM o WHERE o_orderkey % 6 <> 1)
SELECT o.o_orderkey, coalesce(t2, o.title) AS title, coalesce(l2, o.location) AS location, o.salary, CASE WHEN r2 IS NULL OR r2 = 'unknown' THEN o.remote_status ELSE r2 END AS remote_status, coalesce(o.posted_at, p2) AS posted_at,
  coalesce(t2 <> o.title, false) OR coalesce(l2 <> o.location, false) OR coalesce(r2 <> 'unknown' AND r2 <> o.remote_status, false) OR (o.posted_at IS NULL AND p2 IS NOT NULL) AS changed, n.o_orderkey IS NOT NULL AS seen
FROM o LEFT JOIN n ON o.o_orderkey = n.o_orderkey
""")
def refreshed_fields(t: Tables) -> DataFrame:
    """Orders as postings, refreshed by a batch with gaps."""
    old = t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("location"), F.concat(F.lit("x"), (F.col("o_custkey") % 5).cast("string")).alias("salary"),
        F.when(_i() % 3 == 0, "remote").when(_i() % 3 == 1, "hybrid").otherwise("unknown").alias("remote_status"), F.when(_i() % 2 == 0, F.col("o_orderdate")).alias("posted_at"),
    )
    new = old.where("o_orderkey % 6 <> 1").select(
        "o_orderkey", F.when(_i() % 4 != 0, F.concat(F.lit("new "), "title")).alias("title"), F.when(_i() % 7 == 0, "Z").alias("location"), F.lit(None).cast("string").alias("salary"),
        F.when(_i() % 5 == 0, "unknown").otherwise("onsite").alias("remote_status"), ts("2001-01-01 00:00:00").alias("posted_at"),
    )
    return state.refresh(old, new, "o_orderkey")


@query("""
WITH s AS (SELECT 'k' || c_custkey % 900 AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 4 = 0 THEN 'd' || c_custkey END AS domain, c_custkey AS seen FROM customer),
b AS (SELECT k, arg_min(name, seen) AS n, arg_min(industry, seen) FILTER (WHERE industry IS NOT NULL) AS i, arg_min(domain, seen) FILTER (WHERE domain IS NOT NULL) AS d, list_sort(list(DISTINCT name)) AS names FROM s GROUP BY k),
c AS (SELECT DISTINCT 'k' || s_suppkey % 1200 AS k, first_value('old ' || s_suppkey % 1200) OVER (PARTITION BY s_suppkey % 1200) AS name, 'x' AS industry FROM supplier)
SELECT coalesce(c.k, b.k) AS name_key, coalesce(c.name, b.n) AS name, coalesce(c.industry, b.i) AS industry, b.d AS domain, c.k IS NULL AS created,
  array_to_string(list_sort(list_filter(coalesce(b.names, []), lambda x: x <> coalesce(c.name, b.n)))[1:20], ';') AS aliases
FROM c FULL JOIN b ON c.k = b.k
""")
def company_upserts(t: Tables) -> DataFrame:
    """Customers as signals about companies, of which suppliers are known."""
    key = lambda c, n: F.concat(F.lit("k"), (F.col(c) % n).cast("string")).alias("name_key")
    i = F.col("c_custkey")
    signals = t.customer.select(key("c_custkey", 900), F.col("c_name").alias("name"), i.alias("at"), F.when(i % 3 == 0, F.col("c_mktsegment")).alias("industry"), F.when(i % 4 == 0, F.concat(F.lit("d"), i.cast("string"))).alias("domain"))
    old = t.supplier.select(key("s_suppkey", 1200), F.concat(F.lit("old "), (F.col("s_suppkey") % 1200).cast("string")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("x").alias("industry"), F.lit(None).cast("string").alias("domain")).distinct()
    out = state.upsert_companies(old, signals, ["industry", "domain"])
    return out.withColumn("aliases", F.array_join("aliases", ";"))


@query("""
WITH c AS (SELECT 'k' || c_custkey AS k, c_name AS name, 'C' AS tier, CASE WHEN c_custkey % 2 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, CASE WHEN c_custkey % 4 = 0 THEN 'IGNORED' ELSE 'PENDING' END AS review, c_custkey % 11 = 0 AS is_seed FROM customer),
s AS (SELECT 'k' || s_suppkey * 20 AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'A' END AS tier FROM supplier)
SELECT coalesce(c.k, s.k) AS name_key, coalesce(c.name, s.name) AS name, coalesce(s.tier, c.tier, 'B') AS tier,
  CASE WHEN c.k IS NULL OR (s.k IS NOT NULL AND review = 'IGNORED' AND status = 'INACTIVE') THEN 'DISCOVERED' ELSE status END AS status,
  CASE WHEN s.k IS NOT NULL THEN 'ACCEPTED' ELSE review END AS review_status, s.k IS NOT NULL OR coalesce(c.is_seed, false) AS is_seed FROM c FULL JOIN s ON c.k = s.k
""")
def seed_upserts(t: Tables) -> DataFrame:
    i = F.col("c_custkey")
    old = t.customer.select(F.concat(F.lit("k"), i.cast("string")).alias("name_key"), F.col("c_name").alias("name"), F.lit("C").alias("tier"), F.when(i % 2 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"), F.when(i % 4 == 0, "IGNORED").otherwise("PENDING").alias("review_status"), (i % 11 == 0).alias("is_seed"))
    seeds = t.supplier.select(F.concat(F.lit("k"), (F.col("s_suppkey") * 20).cast("string")).alias("name_key"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "A").alias("tier"))
    return state.upsert_seeds(old, seeds)


@query("""
WITH a AS (SELECT l_suppkey AS company, 'u' || l_partkey % 50 AS url, max(l_discount) AS c, 0 AS new FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), b AS (SELECT l_suppkey, 'u' || l_partkey % 50, max(l_discount), 1 FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT company, url, max(c) AS confidence, min(new) = 1 AS created FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
""")
def source_upserts(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("company"), F.concat(F.lit("u"), (F.col("l_partkey") % 50).cast("string")).alias("url"), F.col("l_discount").alias("confidence"), "l_returnflag")
    known = F.col("l_returnflag") == "N"
    return state.upsert_sources(rows.where(known), rows.where(~known))


@query("""
WITH b AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, coalesce(v, c_acctbal) AS score FROM customer LEFT JOIN b USING (c_custkey)
""")
def replaced_scores(t: Tables) -> DataFrame:
    """Balances as scores, replaced by the newest final order's price."""
    old = t.customer.select("c_custkey", F.col("c_acctbal").alias("score"))
    at = F.struct("o_orderdate", "o_orderkey").alias("at")
    new = t.orders.where("o_orderstatus = 'F'").join(t.customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.col("o_totalprice").alias("score"), at)
    return state.replace_by_key(old, new, ["c_custkey"], "at")


@query("SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def rename_cascade(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    renamed = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("renamed "), F.col("c_custkey").cast("string")).alias("c_name"))
    return state.rename_everywhere(rows, renamed, "c_custkey", "c_name").select("o_orderkey", "c_name")


@query("""
WITH e AS (SELECT o_orderkey AS event_id, o_custkey AS company_id, CASE WHEN o_orderstatus = 'P' THEN 'ACCEPTED' ELSE 'PENDING' END AS status FROM orders),
r AS (SELECT event_id, company_id, CASE WHEN event_id % 2 = 0 THEN 'ignore' ELSE 'accept' END AS action, company_id % 4 = 0 AS is_seed FROM e WHERE status = 'PENDING' AND event_id % 37 = 0 AND company_id IN (SELECT c_custkey FROM customer)),
w AS (SELECT company_id, CASE WHEN bool_or(action = 'ignore') THEN 'IGNORED' ELSE 'ACCEPTED' END AS s FROM r WHERE action = 'accept' OR NOT is_seed GROUP BY 1)
SELECT e.event_id, e.company_id, CASE WHEN status <> 'PENDING' THEN status WHEN e.event_id IN (SELECT event_id FROM r WHERE action = 'ignore' AND is_seed) THEN 'IGNORED' ELSE coalesce(s, status) END AS status FROM e LEFT JOIN w USING (company_id)
""")
def reviewed_events(t: Tables) -> DataFrame:
    """Orders as evidence events of customers, of which every 37th is reviewed."""
    events = t.orders.select(_i().alias("event_id"), F.col("o_custkey").alias("company_id"), F.when(F.col("o_orderstatus") == "P", "ACCEPTED").otherwise("PENDING").alias("status"))
    reviews = events.where("event_id % 37 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, "ignore").otherwise("accept").alias("action"))
    companies = t.customer.select(F.col("c_custkey").alias("company_id"), (F.col("c_custkey") % 4 == 0).alias("is_seed"))
    return state.review_events(events, reviews, companies)


@query("""
WITH s AS (SELECT ps::VARCHAR AS source_id, ps % 40 AS company, 'u' || ps % 300 AS url, true AS active FROM (SELECT p_partkey AS ps FROM part)),
m AS (SELECT source_id, min('u' || (source_id::BIGINT * 7) % 900) AS u FROM s WHERE source_id::BIGINT % 9 = 0 GROUP BY 1),
n AS (SELECT 'redirect:' || min(s.source_id) AS source_id, company, u AS url, true AS active FROM s JOIN m USING (source_id) WHERE NOT EXISTS (SELECT 1 FROM s k WHERE k.company = s.company AND k.url = m.u) GROUP BY company, u)
SELECT source_id, company, url, active AND u IS NULL AS active FROM s LEFT JOIN m USING (source_id) UNION ALL SELECT * FROM n
""")
def redirected_sources(t: Tables) -> DataFrame:
    i = F.col("p_partkey")
    sources = t.part.select(i.cast("string").alias("source_id"), (i % 40).alias("company"), F.concat(F.lit("u"), (i % 300).cast("string")).alias("url"), F.lit(True).alias("active"))
    moved = t.part.where("p_partkey % 9 = 0").select(i.cast("string").alias("source_id"), F.concat(F.lit("u"), (i * 7 % 900).cast("string")).alias("new_url"))
    return state.redirect_sources(sources, moved)


_COMPANY = """c AS (SELECT c_custkey AS company_id, CASE c_custkey % 5 WHEN 0 THEN 'S' ELSE 'B' END AS tier, CASE c_custkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'VERIFIED' ELSE 'DISCOVERED' END AS status, CASE WHEN c_custkey % 13 = 0 THEN 'IGNORED' ELSE 'PENDING' END AS review_status, c_custkey % 7 = 0 AS is_seed,
  CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2001-12-01' - to_hours((c_custkey % 100)::INT) END AS last_scanned_at, c_acctbal AS discovery_score FROM customer)"""


@query(f"""
WITH {_COMPANY} SELECT company_id, row_number() OVER (ORDER BY CASE WHEN tier = 'S' THEN 0 ELSE 1 END, last_scanned_at ASC NULLS FIRST, discovery_score DESC, company_id) AS place FROM c
WHERE review_status <> 'IGNORED' AND (status IN ('VERIFIED', 'ACTIVE', 'INACTIVE') OR is_seed) AND (last_scanned_at IS NULL OR last_scanned_at < TIMESTAMP '2001-12-01' - INTERVAL 24 HOUR)
QUALIFY place <= 500
""")
def due_scans(t: Tables) -> DataFrame:
    """The first 500 companies that are due for a scan, in the order of their turn."""
    i = F.col("c_custkey")
    scanned = F.when(i % 3 > 0, ts(ORDERS_NOW) - F.make_interval(hours=(i % 100).cast("int")))
    rows = t.customer.select(
        i.alias("company_id"), F.when(i % 5 == 0, "S").otherwise("B").alias("tier"), F.when(i % 4 == 0, "ACTIVE").when(i % 4 == 1, "VERIFIED").otherwise("DISCOVERED").alias("status"),
        F.when(i % 13 == 0, "IGNORED").otherwise("PENDING").alias("review_status"), (i % 7 == 0).alias("is_seed"), scanned.alias("last_scanned_at"), F.col("c_acctbal").alias("discovery_score"),
    )
    first = listing.page(rows.where(state.due_for_scan(ts(ORDERS_NOW), 24)), state.scan_order(), 500)
    return first.select("company_id", F.row_number().over(Window.orderBy(*state.scan_order())).cast("long").alias("place"))  # 500 rows


_END = "CASE o_orderkey % 3 WHEN 0 THEN '{\"validThrough\": \"' || strftime(o_orderdate, '%Y-%m-%d') || '\"}' WHEN 1 THEN '{\"ExternalPostedEndDate\": \"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z\"}' ELSE '{\"other\": 1}' END"


def _sources(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    payload = F.when(_i() % 3 == 0, F.concat(F.lit('{"validThrough": "'), day, F.lit('"}'))).when(_i() % 3 == 1, F.concat(F.lit('{"ExternalPostedEndDate": "'), moment, F.lit('Z"}'))).otherwise('{"other": 1}')
    return t.orders.select(
        _i().alias("source_id"), payload.alias("raw_payload"), F.when(F.col("o_orderstatus") == "P", "CLOSED").otherwise("OPEN").alias("listing_status"),
        F.element_at(F.array(*(F.lit(x) for x in ("workday", "oracle", "greenhouse"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("source"), F.when(_i() % 4 > 0, F.col("o_orderdate")).alias("last_seen_at"),
    )


@query("SELECT o_orderkey AS source_id, o_orderkey % 3 < 2 AND o_orderdate < TIMESTAMP '1999-01-01' AS expired FROM orders")
def expired_listings(t: Tables) -> DataFrame:
    return _sources(t).select("source_id", state.expired(F.col("raw_payload"), ts("1999-01-01 00:00:00")).alias("expired"))


@query("""
SELECT o_orderkey AS source_id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 3 < 2 AND (o_orderkey % 4 = 0 OR o_orderdate < TIMESTAMP '2001-07-01' - INTERVAL 90 HOUR)
""")
def stale_sources(t: Tables) -> DataFrame:
    return _sources(t).where(state.stale_source(ts("2001-07-01 00:00:00"), ["workday", "oracle", "amazon_jobs", "generic_html"], 30)).select("source_id")


@query("""
WITH c AS (SELECT l_orderkey AS source_id, bool_or(CASE l_linestatus WHEN 'F' THEN l_linenumber > 3 END) AS found FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT o_orderkey AS source_id, CASE WHEN v = 'closed' THEN 'CLOSED' ELSE s END AS listing_status, v AS verdict FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'CLOSED' ELSE 'OPEN' END AS s, CASE WHEN o_orderstatus = 'P' THEN 'unchanged' WHEN (o_orderkey % 3 < 2 AND o_orderdate < TIMESTAMP '1999-01-01') OR NOT found THEN 'closed' WHEN found THEN 'verified' WHEN c.source_id IS NOT NULL THEN 'unverifiable' ELSE 'unchanged' END AS v
  FROM orders LEFT JOIN c ON o_orderkey = c.source_id)
""")
def reconciled_sources(t: Tables) -> DataFrame:
    """Orders as sources with end dates, and lines as pages that were looked at again."""
    checks = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber") > 3).alias("found"))
    return state.reconcile(_sources(t), checks, ts("1999-01-01 00:00:00")).select("source_id", "listing_status", "verdict")
