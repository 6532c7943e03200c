"""Listings, counts, joins and reconciliation over customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import evidence, funnel, listing, ranked
from .registry import ORDERS_NOW, Tables, cents, query, ts

HOURS = f"(epoch(TIMESTAMP '{ORDERS_NOW}') - epoch(o_orderdate)) / 3600.0"
PRECISION = "CASE o_orderkey % 3 WHEN 0 THEN 'datetime' WHEN 1 THEN 'local_datetime' ELSE 'date' END"


def _posted(t: Tables) -> DataFrame:
    """Orders as postings with a precision."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "datetime").when(F.col("o_orderkey") % 3 == 1, "local_datetime").otherwise("date")
    return t.orders.withColumn("precision", kind)


def _oldest(days: str = "o_orderdate"):
    return dates.age_bounds(F.col(days), F.col("precision"), ts(ORDERS_NOW))[1]


@query("""
SELECT c_custkey, c_name, coalesce(n_all, 0) AS n_all, coalesce(n_final, 0) AS n_final, coalesce(n_recent, 0) AS n_recent, coalesce(n_urgent, 0) AS n_urgent
FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n_all, count_if(o_orderstatus = 'F') AS n_final, count_if(o_orderdate >= TIMESTAMP '2001-12-01' - INTERVAL 365 DAY) AS n_recent, count_if(o_orderpriority LIKE '1%') AS n_urgent
  FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
WHERE c_acctbal >= 0 AND contains(lower(c_mktsegment), 'b')
""")
def entity_counts_listing(t: Tables) -> DataFrame:
    conditions = {
        "n_all": F.lit(True),
        "n_final": F.col("o_orderstatus") == "F",
        "n_recent": F.col("o_orderdate") >= ts(ORDERS_NOW) - F.expr("INTERVAL 365 DAY"),
        "n_urgent": F.col("o_orderpriority").startswith("1"),
    }
    wanted = listing.matching(t.customer, F.col("c_acctbal") >= 0, listing.contains(F.col("c_mktsegment"), "b"), None)
    return listing.with_counts(wanted, "c_custkey", t.orders, "o_custkey", conditions).select("c_custkey", "c_name", *conditions)


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100
""")
def jobs_page(t: Tables) -> DataFrame:
    rows = listing.matching(t.orders, listing.among(F.col("o_orderstatus"), "f, o", F.lit(True)), F.col("o_totalprice") >= 1000)
    return listing.page(rows.select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 100)


@query(f"""
WITH o AS (SELECT {PRECISION} AS precision, {HOURS} AS age FROM orders),
b AS (SELECT precision, greatest(0, age + CASE WHEN precision = 'datetime' THEN 0 ELSE 14 END) AS oldest FROM o)
SELECT precision, CASE WHEN oldest <= 12 THEN '0-12h' WHEN oldest <= 24 THEN '12-24h' WHEN oldest <= 48 THEN '24-48h' WHEN oldest <= 168 THEN '2-7d' ELSE '7d+' END AS bucket,
  CASE WHEN oldest <= 10000 THEN 'fresh' WHEN oldest <= 30000 THEN 'recent' ELSE 'stale' END AS status, count(*) AS n
FROM b GROUP BY ALL
""")
def freshness_buckets(t: Tables) -> DataFrame:
    rows = _posted(t).select("precision", _oldest().alias("oldest"))
    return rows.groupBy("precision", dates.freshness_bucket(F.col("oldest")).alias("bucket"), dates.freshness_status(F.col("oldest"), 10_000, 30_000).alias("status")).agg(F.count("*").alias("n"))


@query(f"""
WITH o AS (SELECT o_orderkey, greatest(0, {HOURS.replace(ORDERS_NOW, '2001-08-02 00:00:00')} + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 14 END) AS oldest FROM orders)
SELECT o_orderkey, CASE WHEN oldest <= 12 THEN 100.0::DOUBLE WHEN oldest <= 24 THEN 95 WHEN oldest <= 48 THEN 88 WHEN oldest <= 72 THEN 75 WHEN oldest <= 168 THEN 60 WHEN oldest <= 336 THEN 40 WHEN oldest <= 720 THEN 25 ELSE 10 END AS step_score,
  greatest(0, 1000 - oldest) AS hours_left FROM o
""")
def freshness_scores(t: Tables) -> DataFrame:
    at = ts("2001-08-02 00:00:00")
    oldest = dates.age_bounds(F.col("o_orderdate"), F.col("precision"), at)[1]
    rows = _posted(t).select("o_orderkey", oldest.alias("oldest"))
    return rows.select("o_orderkey", dates.freshness_score(F.col("oldest")).alias("step_score"), F.greatest(F.lit(0.0), 1000 - F.col("oldest")).alias("hours_left"))


@query(f"""
WITH o AS (SELECT {PRECISION} AS p, {HOURS} AS age FROM orders),
w AS (SELECT (p = 'datetime' AND age <= 10000) OR (p IN ('date', 'local_datetime') AND age <= 9986) AS fresh FROM o)
SELECT fresh, count(*) AS n FROM w GROUP BY fresh
""")
def freshness_filter(t: Tables) -> DataFrame:
    fresh = dates.within(F.col("o_orderdate"), F.col("precision"), ts(ORDERS_NOW), 10_000)
    return _posted(t).groupBy(fresh.alias("fresh")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return funnel.status_counts(t.orders, "o_orderstatus")


@query("SELECT count_if(o_orderstatus IN ('O', 'P')) AS active, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus IN ('X')) AS other FROM orders")
def dashboard_rollup(t: Tables) -> DataFrame:
    return funnel.rollup(t.orders, "o_orderstatus", {"active": ["O", "P"], "done": ["F"], "other": ["X"]})


@query("""
SELECT n_nationkey, n_name, count(*) AS fresh_orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 8
""")
def fresh_top_groups(t: Tables) -> DataFrame:
    per_customer = t.orders.where(F.col("o_orderdate") >= ts("2001-01-01 00:00:00")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("fresh_orders"))
    named = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", "fresh_orders")
    return listing.page(named, [F.desc("fresh_orders"), F.asc("n_nationkey")], 8)


@query("""
WITH w AS (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word, count(*) AS parts, sum(p_size)::BIGINT AS sizes FROM w GROUP BY word
""")
def multi_value_breakdown(t: Tables) -> DataFrame:
    words = t.part.select("p_size", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, p_key ORDER BY ord, o_totalprice DESC, o_orderkey) AS k FROM (
    SELECT *, strftime(o_orderdate, '%Y-%m') AS p_key, substr(o_orderpriority, 1, 1)::INT AS ord FROM orders WHERE o_orderstatus <> 'P')),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ord, o_totalprice DESC, o_orderkey) - 1 AS turn FROM r WHERE k = 1)
SELECT o_orderkey, o_custkey, ord AS ordinal, turn FROM s ORDER BY ord, turn, o_totalprice DESC, o_orderkey LIMIT 6
""")
def today_plan(t: Tables) -> DataFrame:
    """Orders as openings: the priority is the class, the customer the company, orders of one month are re-posts."""
    done = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    rows = t.orders.join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("posting"), F.substring("o_orderpriority", 1, 1).cast("int").alias("ordinal"), "o_totalprice")
    chosen = ranked.plan(rows, "o_custkey", "posting", "ordinal", "o_totalprice", "o_orderkey", 6)
    return chosen.select("o_orderkey", "o_custkey", "ordinal", F.col("turn").cast("long").alias("turn"))


@query("""
WITH c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, 30 + o_orderkey % 40 AS minutes FROM orders QUALIFY place <= 6),
RECURSIVE_FOLD AS (SELECT list(struct_pack(k := o_orderkey, m := minutes) ORDER BY place) AS l FROM c)
SELECT x.k AS o_orderkey, x.m AS minutes FROM (
  SELECT unnest(list_reduce(l, lambda a, b: CASE WHEN length(a) < 3 AND (length(a) = 0 OR list_sum(list_transform(a, lambda y: y.m)) + b[1].m <= 135) THEN a || b ELSE a END, [])) AS x
  FROM (SELECT list_transform(l, lambda y: [y]) AS l FROM RECURSIVE_FOLD))
""")
def plan_in_budget(t: Tables) -> DataFrame:
    """The dearest six orders, of which at most three are taken while their minutes fit."""
    best = t.orders.select("o_orderkey", "o_totalprice", (30 + F.col("o_orderkey") % 40).alias("minutes")).orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(6)
    keyed = best.select((-F.col("o_totalprice")).alias("_price"), "o_orderkey", "minutes")
    return ranked.within_budget(keyed, ["_price", "o_orderkey"], "minutes", 3, 135).select("o_orderkey", "minutes")


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, avg(o_totalprice::DECIMAL(18, 2)::DOUBLE) AS mean_of_top FROM m WHERE k <= 1 GROUP BY 1
""")
def best_mean(t: Tables) -> DataFrame:
    return evidence.mean_of_top(t.orders, "o_custkey", "o_totalprice", 1)


@query("""
WITH m AS (SELECT o_custkey, o_totalprice::DECIMAL(18, 2) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, sum(p)::DOUBLE AS top3_total, count(*) AS n FROM m WHERE k <= 3 GROUP BY 1
""")
def top3_totals(t: Tables) -> DataFrame:
    rows = ranked.top(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return rows.groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).cast("double").alias("top3_total"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1999-01-01')")
def reconcile_anti(t: Tables) -> DataFrame:
    seen = t.lineitem.where(F.col("l_shipdate") >= ts("1999-01-01 00:00:00")).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(seen, "o_orderkey", "left_anti")


@query("SELECT l_orderkey, bool_and(l_linestatus = 'F') AS closed, bool_or(l_returnflag = 'R') AS any_returned, count(*) AS lines FROM lineitem GROUP BY 1")
def close_all(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("closed"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.count("*").alias("lines"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def jobs_with_source(t: Tables) -> DataFrame:
    """A semi-join in place of a join and distinct."""
    return t.orders.select("o_orderkey", "o_totalprice").join(t.lineitem.where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("""
WITH k AS (SELECT c_custkey, c_nationkey * 1000 + c_custkey % 40 AS a, c_mktsegment || c_custkey % 30 AS b FROM customer),
p AS (SELECT s_suppkey, s_nationkey * 1000 + s_suppkey % 40 AS a, ['BUILDING', 'MACHINERY', 'AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD'][1 + s_suppkey % 5] || s_suppkey % 30 AS b FROM supplier)
SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM p WHERE p.a = k.a), (SELECT min(s_suppkey) FROM p WHERE p.b = k.b)) AS matched_id FROM k
""")
def priority_fallback_join(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", (F.col("c_nationkey").cast("long") * 1000 + F.col("c_custkey") % 40).alias("a"), F.concat("c_mktsegment", (F.col("c_custkey") % 30).cast("string")).alias("b"))
    segments = F.array(*(F.lit(s) for s in ("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD")))
    targets = t.supplier.select("s_suppkey", (F.col("s_nationkey").cast("long") * 1000 + F.col("s_suppkey") % 40).alias("ta"), F.concat(F.get(segments, (F.col("s_suppkey") % 5).cast("int")), (F.col("s_suppkey") % 30).cast("string")).alias("tb"))
    return listing.first_match(rows, targets, "s_suppkey", [("a", "ta"), ("b", "tb")]).select("c_custkey", "matched_id")


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)
SELECT src, dst, coalesce(a.n_name, 'UNKNOWN') AS src_name, coalesce(b.n_name, 'UNKNOWN') AS dst_name FROM e LEFT JOIN nation a ON src = a.n_nationkey LEFT JOIN nation b ON dst = b.n_nationkey
""")
def edge_endpoints(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    rows = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.select("src", "dst").where("src <> dst").distinct()
    return listing.with_names(edges, {"src": "src_name", "dst": "dst_name"}, t.nation, "n_nationkey", "n_name")


@query("""
WITH p AS (SELECT r_name, c_mktsegment, row_number() OVER (ORDER BY r_name, c_mktsegment) - 1 AS i, count(*) OVER () AS n FROM region, (SELECT DISTINCT c_mktsegment FROM customer))
SELECT r_name, c_mktsegment, ((i - 7) % n + n) % n AS slot FROM p WHERE ((i - 7) % n + n) % n < 8
""")
def query_plan_rotation(t: Tables) -> DataFrame:
    plan = listing.rotated_product(t.region.select("r_name"), t.customer.select("c_mktsegment").distinct(), ["r_name", "c_mktsegment"], 7, 8)
    return plan.withColumn("slot", F.col("slot").cast("long"))


@query("""
WITH d AS (SELECT o_custkey AS k, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS a FROM orders), i AS (SELECT DISTINCT k, unnest(generate_series(a, a + 29)) AS day FROM d)
SELECT k AS o_custkey, count(*) AS covered FROM i GROUP BY 1
""")
def interval_union(t: Tables) -> DataFrame:
    """Days on which a customer has an order of at most 30 days ago."""
    start = F.date_diff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    rows = t.orders.select("o_custkey", start.alias("a"), (start + 30).alias("b"))
    return ranked.union_length(rows, ["o_custkey"], "a", "b").select("o_custkey", "covered")


@query("""
WITH b AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS best FROM lineitem)
SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM b WHERE l_extendedprice >= 0.5 * best) WHERE rank <= 2
""")
def relative_to_max(t: Tables) -> DataFrame:
    rows = ranked.near_best(t.lineitem, ["l_orderkey"], "l_extendedprice", 0.5, [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 2)
    return rows.select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT o_orderkey, upper(substr(o_orderstatus, 1, 1)) || row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS label FROM orders
""")
def requirement_numbers(t: Tables) -> DataFrame:
    return ranked.numbered(t.orders, ["o_custkey", "o_orderstatus"], [F.asc("o_orderdate"), F.asc("o_orderkey")], F.upper(F.substring("o_orderstatus", 1, 1)), "label").select("o_orderkey", "label")


@query("""
WITH old AS (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT o_orderkey, coalesce(v, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) AS version FROM orders o LEFT JOIN old ON old.o_custkey = o.o_custkey WHERE o_orderdate >= TIMESTAMP '1999-01-01'
""")
def next_versions(t: Tables) -> DataFrame:
    cut = ts("1999-01-01 00:00:00")
    old = t.orders.where(F.col("o_orderdate") < cut).groupBy("o_custkey").agg(F.count("*").alias("version"))
    return ranked.next_version(t.orders.where(F.col("o_orderdate") >= cut), old, ["o_custkey"], [F.asc("o_orderkey")], "version").select("o_orderkey", "version")


@query("""
SELECT l_suppkey AS company, max(l_quantity) AS priority, min(l_linenumber) AS depth, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS reason FROM lineitem GROUP BY 1
""")
def frontier_upsert(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("company"), F.col("l_quantity").alias("priority"), F.col("l_linenumber").alias("depth"), F.col("l_returnflag").alias("reason"), "l_shipdate")
    cut = ts("1998-01-01 00:00:00")
    early, late = rows.where(F.col("l_shipdate") < cut).drop("l_shipdate"), rows.where(F.col("l_shipdate") >= cut).drop("l_shipdate")
    return evidence.merge_frontier(early, late)


@query("""
SELECT c_nationkey AS source, s_nationkey AS target, o_orderpriority AS kind, max(l_quantity) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3
""")
def relationship_upsert(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("confidence")).join(t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("kind")), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("source")), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("target")), F.col("l_suppkey") == F.col("s_suppkey"))
    return evidence.merge_edges(rows, "source", "target", "kind", "confidence")


@query("""
SELECT p_partkey, CASE WHEN p_size <= 0 THEN NULL WHEN p_size * 300 <= 10 THEN '1-10' WHEN p_size * 300 <= 50 THEN '11-50' WHEN p_size * 300 <= 200 THEN '51-200' WHEN p_size * 300 <= 500 THEN '201-500' WHEN p_size * 300 <= 1000 THEN '501-1000' WHEN p_size * 300 <= 5000 THEN '1001-5000' WHEN p_size * 300 <= 10000 THEN '5001-10000' ELSE '10000+' END AS size_range,
  least(900, 30 * pow(2, p_size % 8)) AS delay, CASE WHEN p_size >= 38 THEN 'high' WHEN p_size >= 23 THEN 'medium' ELSE 'low' END AS band FROM part
""")
def scalar_bands(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", dates.employee_range(F.col("p_size") * 300).alias("size_range"), dates.retry_delay(F.col("p_size") % 8).alias("delay"), dates.confidence_band(F.col("p_size") / 50).alias("band"))
