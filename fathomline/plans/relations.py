"""Joins, sorts and set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, scores
from ..operators import companies, evidence, listing, matching, queues, ranked
from .registry import EVENTS_NOW, ORDERS_NOW, Tables, cents, query, ts


@query("""
WITH j AS (SELECT l_suppkey, l_quantity, p_size, o_orderstatus, o_orderdate, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM j)
SELECT l_suppkey, count(*) AS jobs, sum(CASE WHEN r <= 3 THEN l_quantity END) / 3 AS best_fit, count_if(p_size > 25) AS places_ok, count(DISTINCT p_brand) AS terms, count_if(o_orderstatus = 'F') AS pay_known, count_if(o_orderdate >= TIMESTAMP '2001-06-01') AS fresh FROM k GROUP BY 1
""")
def target_inputs(t: Tables) -> DataFrame:
    """What a company's target score is made of, for all suppliers in one pass: match, job and analysis joined, then grouped."""
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity").join(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_size", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    best = evidence.mean_of_top(t.lineitem, "l_suppkey", "l_quantity").withColumnRenamed("mean_of_top", "best_fit")
    out = rows.groupBy("l_suppkey").agg(F.count("*").alias("jobs"), F.count_if(F.col("p_size") > 25).alias("places_ok"), F.count_distinct("p_brand").alias("terms"), F.count_if(F.col("o_orderstatus") == "F").alias("pay_known"), F.count_if(F.col("o_orderdate") >= ts("2001-06-01 00:00:00")).alias("fresh"))
    return out.join(best, "l_suppkey")


@query("SELECT event_id, user_id, c_name, event_type FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('click', 'purchase')")
def feed_events(t: Tables) -> DataFrame:
    rows = t.events.where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "event_type")
    return rows.join(t.customer.select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey")).drop("c_custkey")


@query("""
WITH f AS (SELECT user_id, max(value) AS priority, CASE WHEN user_id % 3 = 0 THEN 'EXPLORED' WHEN user_id % 3 = 1 THEN 'PENDING' ELSE 'SKIPPED' END AS status FROM events GROUP BY user_id)
SELECT user_id, c_name, status, priority, row_number() OVER (ORDER BY CASE status WHEN 'PENDING' THEN 0 WHEN 'EXPLORED' THEN 1 ELSE 2 END, priority DESC, user_id) AS place FROM f JOIN customer ON user_id = c_custkey QUALIFY place <= 40
""")
def frontier_page(t: Tables) -> DataFrame:
    status = F.when(F.col("user_id") % 3 == 0, "EXPLORED").when(F.col("user_id") % 3 == 1, "PENDING").otherwise("SKIPPED")
    rows = t.events.groupBy("user_id").agg(F.max("value").alias("priority")).withColumn("status", status)
    named = rows.join(t.customer.select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey")).drop("c_custkey")
    order = [F.asc(listing.by_level(F.col("status"), ["PENDING", "EXPLORED"])), F.desc("priority"), F.asc("user_id")]
    first = listing.page(named, order, 40)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # 40 rows


@query("""
WITH s AS (SELECT o_custkey, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, coalesce(score, -1) AS score, row_number() OVER (ORDER BY coalesce(score, -1) DESC, c_custkey) AS place FROM customer LEFT JOIN s ON c_custkey = o_custkey QUALIFY place <= 200
""")
def companies_by_target(t: Tables) -> DataFrame:
    """Companies with a target score that only some have, those without last."""
    s = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("score"))
    rows = t.customer.select("c_custkey").join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("score", F.lit(-1.0)).alias("score"))
    order = [F.desc("score"), F.asc("c_custkey")]
    return listing.page(rows, order, 200).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # 200 rows


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0 LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def variants_with_names(t: Tables) -> DataFrame:
    known = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.join(t.nation.where("n_nationkey < 20").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("""
SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) AS scored_jobs, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') AS draft_lines
""")
def dashboard_counts(t: Tables) -> DataFrame:
    a = t.orders.select("o_custkey").join(t.customer.where("c_acctbal > 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.lit("a").alias("kind"))
    b = t.lineitem.select("l_orderkey").join(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("b").alias("kind"))
    return a.unionByName(b).agg(F.count_if(F.col("kind") == "a").alias("scored_jobs"), F.count_if(F.col("kind") == "b").alias("draft_lines"))


@query("""
WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)
SELECT p.o_orderkey, o_totalprice, count(l_orderkey) AS n_lines, max(l_quantity) AS most, count(l_orderkey) > 0 AS has_lines FROM p LEFT JOIN lineitem ON l_orderkey = p.o_orderkey GROUP BY 1, 2
""")
def page_details(t: Tables) -> DataFrame:
    """Details are looked up after the page is cut, so that only a hundred keys meet the lines, before those are grouped."""
    first = listing.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)
    lines = t.lineitem.select("l_orderkey", "l_quantity").join(F.broadcast(first.select("o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")  # 100 keys
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.max("l_quantity").alias("most"))
    out = first.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return out.withColumn("n_lines", F.coalesce("n_lines", F.lit(0).cast("long"))).withColumn("has_lines", F.col("n_lines") > 0)


@query("""
WITH b AS (SELECT p_partkey AS board_id, replace(p_name, ' ', '') AS k, p_brand || ' ' || p_name || ' jobs' AS title FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT 'c' || name AS company_id, name AS name_key, name FROM w)
SELECT board_id, company_id FROM b JOIN c ON b.k = name_key OR (length(name_key) >= 4 AND contains(b.k, name_key)) OR contains(' ' || b.title || ' ', ' ' || c.name || ' ')
""")
def board_companies(t: Tables) -> DataFrame:
    """Parts as boards, words of their names as companies."""
    boards = t.part.select(F.col("p_partkey").alias("board_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("key"), F.concat_ws(" ", "p_brand", "p_name", F.lit("jobs")).alias("title"))
    words = t.part.where("p_partkey % 3 = 0").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return listing.board_matches(boards, words.select(F.concat(F.lit("c"), "name").alias("company_id"), F.col("name").alias("name_key"), "name"))


@query("""
WITH a AS (SELECT s_suppkey, unnest([s_suppkey % 40, 1000 + s_suppkey % 13]) AS x FROM supplier), b AS (SELECT p_partkey, unnest([p_size, 1000 + p_partkey % 400]) AS x FROM part) SELECT DISTINCT s_suppkey, p_partkey FROM a JOIN b USING (x)
""")
def alias_overlaps(t: Tables) -> DataFrame:
    a = t.supplier.select("s_suppkey", F.array(F.col("s_suppkey") % 40, 1000 + F.col("s_suppkey") % 13).alias("aliases"))
    b = t.part.select("p_partkey", F.array(F.col("p_size").cast("long"), 1000 + F.col("p_partkey") % 400).alias("aliases"))
    return listing.overlapping(a, "s_suppkey", b, "p_partkey")


@query("""
WITH a AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' group' ELSE '' END AS n FROM part), b AS (SELECT DISTINCT p_name AS m FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part)
SELECT p_partkey, m FROM a JOIN b ON n = m OR starts_with(n, m || ' ') OR starts_with(m, n || ' ')
""")
def employer_prefixes(t: Tables) -> DataFrame:
    a = t.part.select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " group").otherwise("")).alias("n"))
    b = t.part.select(F.col("p_name").alias("m")).union(t.part.select(F.get(F.split("p_name", " "), F.lit(0)))).distinct()
    return listing.word_prefixes(a, "p_partkey", "n", b.withColumn("name", F.col("m")), "m", "name")


@query("""
WITH a AS (SELECT c_nationkey AS k, 'customer' AS provider, c_acctbal AS confidence FROM customer), b AS (SELECT s_nationkey, 'supplier', s_acctbal FROM supplier), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT k, provider, confidence, row_number() OVER (ORDER BY (provider = 'supplier')::INT DESC, confidence DESC, k) AS place FROM u QUALIFY place <= 60
""")
def merged_signals(t: Tables) -> DataFrame:
    """Signals of two providers in one list, hiring evidence first, then by confidence."""
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("provider"), F.col("c_acctbal").alias("confidence"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("provider"), F.col("s_acctbal").alias("confidence"))
    order = [F.desc((F.col("provider") == "supplier").cast("int")), F.desc("confidence"), F.asc("k")]
    return listing.page(a.unionByName(b), order, 60).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # 60 rows


@query("""
WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), o AS (SELECT user_id, list_distinct(list(event_type)) AS y FROM events WHERE event_id % 5 = 0 GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_distinct(x || coalesce(y, []))), ';') AS either, array_to_string(list_sort(list_intersect(x, coalesce(y, []))), ';') AS both, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(coalesce(y, []), v))), ';') AS only_first FROM s LEFT JOIN o USING (user_id)
""")
def type_sets(t: Tables) -> DataFrame:
    """Union, intersection and difference of the sets of event types of two samples of a user's history."""
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("x"), F.collect_set(F.when(F.col("event_id") % 5 == 0, F.col("event_type"))).alias("y"))
    out = lambda c: F.array_join(F.array_sort(c), ";")
    return sets.where(F.size("x") > 0).select("user_id", out(F.array_union("x", "y")).alias("either"), out(F.array_intersect("x", "y")).alias("both"), out(F.array_except("x", "y")).alias("only_first"))


@query("""
WITH f AS (SELECT l_suppkey AS candidate, 'T' || l_partkey % 40 AS name, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), v AS (SELECT *, CASE WHEN q >= 49 THEN 'STRONG' WHEN q >= 40 THEN 'MODERATE' WHEN q >= 30 THEN 'LISTED' ELSE 'OTHER' END AS level FROM f)
SELECT candidate, array_to_string(list(name ORDER BY CASE level WHEN 'STRONG' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'LISTED' THEN 2 ELSE 3 END, name), ';') AS skills FROM v GROUP BY 1
""")
def skills_by_level(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("candidate"), F.concat(F.lit("T"), (F.col("l_partkey") % 40).cast("string")).alias("name")).agg(F.max("l_quantity").alias("q"))
    level = F.when(F.col("q") >= 49, "STRONG").when(F.col("q") >= 40, "MODERATE").when(F.col("q") >= 30, "LISTED").otherwise("OTHER")
    entry = F.struct(listing.by_level(level, ["STRONG", "MODERATE", "LISTED"]).alias("place"), "name")
    return rows.groupBy("candidate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["name"]), ";").alias("skills"))


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS posted, o_totalprice FROM orders)
SELECT o_orderkey, posted, row_number() OVER (ORDER BY posted DESC NULLS LAST, o_totalprice DESC, o_orderkey) AS place FROM r QUALIFY place <= 300
""")
def newest_posted(t: Tables) -> DataFrame:
    """Newest first, undated ones last."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("posted"), "o_totalprice")
    order = [F.desc_nulls_last("posted"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return listing.page(rows, order, 300).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("o_totalprice")  # 300 rows


@query("""
WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS n, max(c_acctbal) AS fit FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, n, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, fit DESC, c_nationkey) AS place FROM g) WHERE place <= 8
""")
def top_groups(t: Tables) -> DataFrame:
    groups = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("fit"))
    out = ranked.top(groups, ["c_mktsegment"], [F.desc("n"), F.desc("fit"), F.asc("c_nationkey")], 8, "place")
    return out.select("c_mktsegment", "c_nationkey", "n", F.col("place").cast("long").alias("place"))


@query("""
SELECT o_orderkey, array_to_string(list_sort(list(l_partkey))[1:3], ';') AS first_parts, substr(any_value(o_orderpriority), 1, 4) AS short, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def wide_projection(t: Tables) -> DataFrame:
    """A page's row with the first few of its list and a shortened text."""
    parts = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.slice(F.array_sort(F.collect_list("l_partkey")), 1, 3), ";").alias("first_parts"), F.count("*").alias("n"))
    return t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 4).alias("short")).join(parts, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("""
SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'e') AND p_size IN (1, 5, 9, 20, 33) AND p_retailprice >= 1000
""")
def client_filter(t: Tables) -> DataFrame:
    kept = listing.matching(t.part, listing.searched("E", F.col("p_name"), F.col("p_brand"), F.col("p_type")), F.col("p_size").isin(1, 5, 9, 20, 33), F.col("p_retailprice") >= 1000)
    return kept.select("p_partkey")


@query("SELECT c_custkey, (c_custkey % 5 = 0 OR contains(lower(c_mktsegment), 'build')) AS in_place FROM customer")
def place_filter(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", listing.in_place(F.col("c_mktsegment"), F.col("c_custkey") % 5 == 0, "Build", "build").alias("in_place"))


@query("""
SELECT c_mktsegment AS category, count(*) AS facts, count_if(c_acctbal > 0) AS active, count_if(c_acctbal > 0 AND c_custkey % 2 = 0) AS confirmed FROM customer GROUP BY 1
""")
def profile_stats(t: Tables) -> DataFrame:
    return listing.counts_by(t.customer.withColumnRenamed("c_mktsegment", "category"), "category", {"facts": F.lit(True), "active": F.col("c_acctbal") > 0, "confirmed": (F.col("c_acctbal") > 0) & (F.col("c_custkey") % 2 == 0)})


@query("""
WITH e AS (SELECT user_id, event_type AS k, value AS v, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR) SELECT user_id || ':' || k AS "key", max(ts) AS fetched_at, arg_max(v, (ts, v)) AS value FROM e GROUP BY 1
""")
def cached_values(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "value", F.col("ts").alias("fetched_at"))
    return listing.cached(rows, ts(EVENTS_NOW), 240 * 3600)


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'UNKNOWN' ELSE 'RELOCATION' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 95 WHEN 2 THEN 60 ELSE 40 END AS score FROM orders
""")
def location_fits(t: Tables) -> DataFrame:
    place = F.element_at(F.array(*(F.lit(x) for x in ("Paris; Pune, India", "Remote - India", "", "Oslo"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return matching.location_fit(t.orders.select("o_orderkey", place.alias("place")), "o_orderkey", "place", ["Pune"], True, "India", True, True)


@query("""
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 ELSE 0 END AS evidence, CASE s_suppkey % 5 WHEN 0 THEN 'acme' WHEN 1 THEN 'acme' WHEN 2 THEN 'acmedatalabs' WHEN 3 THEN 'acme' ELSE 'cafe' END AS name_key FROM supplier
""")
def domain_evidence(t: Tables) -> DataFrame:
    i = F.col("s_suppkey") % 5
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (i + 1).cast("int"))
    name, domain = pick("Acme Inc.", "ACME", "Acmedata Labs", "Acme (YC)", "Café Ltd"), pick("acme.com", "acme-careers.io", "acmedata.co.uk", "other.com", "x.y")
    return t.supplier.select("s_suppkey", companies.domain_evidence(name, domain).alias("evidence"), companies.name_key(name).alias("name_key"))


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS h, count_if(o_orderstatus = 'P') AS p, o_custkey % 2 = 0 AS india, o_custkey % 3 = 0 AS product, o_custkey % 100 AS age, o_custkey % 7 = 0 AS seed FROM orders GROUP BY 1)
SELECT o_custkey, (CASE WHEN greatest(n, h) >= 5 THEN 50 WHEN greatest(n, h) >= 3 THEN 35 WHEN greatest(n, h) >= 1 THEN 15 ELSE 0 END + CASE WHEN p > 0 THEN 30 ELSE 0 END + CASE WHEN p >= 2 THEN 20 ELSE 0 END + CASE WHEN india THEN 15 ELSE 0 END + CASE WHEN product THEN 10 ELSE 0 END + CASE WHEN age <= 48 THEN 15 ELSE 0 END + CASE WHEN seed THEN 25 ELSE 0 END)::DOUBLE AS priority FROM s
""")
def frontier_points(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    stats = t.orders.groupBy("o_custkey").agg(F.count("*").alias("data_roles"), F.count_if(F.col("o_orderstatus") == "F").alias("hiring_signals"), F.count_if(F.col("o_orderstatus") == "P").alias("hiring_posts"))
    rows = stats.withColumns({"hiring_sources": F.col("hiring_posts"), "india_presence": k % 2 == 0, "product_company": k % 3 == 0, "signal_age_hours": k % 100, "is_seed": k % 7 == 0})
    return companies.frontier_points(rows).select("o_custkey", "priority")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - to_hours(0) WHEN 1 THEN date_trunc('second', o_orderdate) WHEN 2 THEN date_trunc('day', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS posted_at, CASE o_orderkey % 4 WHEN 0 THEN 'datetime' WHEN 1 THEN 'local_datetime' ELSE 'date' END AS precision FROM (SELECT o_orderkey, date_trunc('second', o_orderdate) AS o_orderdate FROM orders)
""")
def parsed_times(t: Tables) -> DataFrame:
    """Times in the forms of four sources, read back: epoch milliseconds, ISO without zone, ISO dates, English dates."""
    i, at = F.col("o_orderkey") % 4, F.date_trunc("second", F.col("o_orderdate").cast("timestamp"))
    shown = F.when(i == 0, (F.unix_seconds(at) * 1000).cast("string")).when(i == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(i == 2, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", dates.parse_posted(shown).alias("p")).select("o_orderkey", F.col("p.value").cast("timestamp_ntz").alias("posted_at"), "p.precision")


@query("""
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN DATE '2001-12-01' WHEN 1 THEN DATE '2001-11-30' WHEN 2 THEN DATE '2001-11-24' END AS day, CASE WHEN s_suppkey % 2 = 0 THEN 2024 * 12 + 5 ELSE 2001 * 12 + 12 END AS month FROM supplier
""")
def relative_days(t: Tables) -> DataFrame:
    i = F.col("s_suppkey")
    label = F.when(i % 5 == 0, "Posted Today").when(i % 5 == 1, "Posted Yesterday").when(i % 5 == 2, "Posted 7 Days Ago").when(i % 5 == 3, "Posted 30+ Days Ago").otherwise("soon")
    month = F.when(i % 2 == 0, "2024-05").otherwise("present")
    return t.supplier.select("s_suppkey", dates.days_ago(label, F.to_date(ts(ORDERS_NOW))).alias("day"), dates.month_index(month, ts(ORDERS_NOW)).alias("month"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS skills, 100 - l_linenumber * 10 AS seniority, l_discount * 1000 AS location FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(((skills * 0.4 + seniority * 0.2 + location * 0.2 + 60 * 0.1) / 0.9)::DECIMAL(20, 6), 1)::DOUBLE AS fit, CASE WHEN skills >= 70 THEN 'skills' ELSE '' END || CASE WHEN location < 40 THEN ';far' ELSE '' END AS notes FROM p
""")
def composed_fits(t: Tables) -> DataFrame:
    """A fit of weighted components with the notes that explain it."""
    parts = {"skills": F.col("l_quantity") * 2, "seniority": 100.0 - F.col("l_linenumber") * 10, "location": F.col("l_discount") * 1000, "compensation": F.lit(60.0)}
    fit = matching.composed_fit(parts, {"skills": 0.4, "seniority": 0.2, "location": 0.2, "compensation": 0.1, "domain": 0.1})
    notes = F.concat(F.when(parts["skills"] >= 70, "skills").otherwise(""), F.when(parts["location"] < 40, ";far").otherwise(""))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", fit.alias("fit"), notes.alias("notes"))


@query("""
WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE 'x' END AS tier FROM customer)
SELECT c_custkey, round(least(CASE WHEN c_custkey % 9 = 0 THEN 35 ELSE 1000 END, (least(100, 20.0 * (c_custkey % 4) + 15.0 * (c_custkey % 2)) * (c_custkey % 4 > 0)::INT * 0.2 + 50 * 0.15 + 50 * 0.1 + 80 * 0.1 + (CASE WHEN tier = 'S' THEN 100 ELSE 50 END * 0.5 + 25) * 0.1 + 85 * 0.05 + 50 * 0.15 + 75 * 0.15))::DECIMAL(20, 6), 1)::DOUBLE AS target_score FROM s
""")
def target_scores(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey", (k % 4).alias("open_roles"), (k % 2).alias("fresh_roles"), F.lit(None).cast("double").alias("best_fit"), F.create_map().cast("map<string,double>").alias("discovery"), F.when(k % 2 == 0, "S").otherwise("x").alias("tier"), F.lit("a SaaS startup").alias("kind"),
        F.lit(True).alias("pay_known"), F.lit(True).alias("pay_match"), F.lit(2).alias("places"), F.lit(1).alias("places_ok"), F.lit(False).alias("india"), F.lit(False).alias("remote"), F.lit(4).alias("terms"), F.lit(3).alias("terms_known"),
    )
    return companies.target_score(rows, k % 9 == 0).select("c_custkey", "target_score")


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'data_engineering' WHEN 1 THEN 'non_target' WHEN 2 THEN 'other_engineering' WHEN 3 THEN 'unclassified' WHEN 4 THEN 'data_engineering' ELSE 'data_engineering' END AS category FROM supplier
""")
def role_categories(t: Tables) -> DataFrame:
    """Roles by their titles; an employer's name is taken out of the description only where it stands alone."""
    from ..functions import jobs

    i = F.col("s_suppkey") % 6
    title = F.element_at(F.array(*(F.lit(x) for x in ("Senior Data Engineer", "Chef", "Software Engineer", "", "Data Engineer, Payments", "Big Data Engineer"))), (i + 1).cast("int"))
    return t.supplier.select("s_suppkey", jobs.classify_role(title, F.lit("Sparkling work at Spark."), F.lit("Spark"))["category"].alias("category"))


@query("""
SELECT o_custkey, round(sum(o_totalprice::DECIMAL(18, 2)), 2)::DOUBLE AS used, greatest(0, least(5000, 900000 - sum(o_totalprice::DECIMAL(18, 2))))::DOUBLE AS allowed FROM orders GROUP BY 1
""")
def budgets_left(t: Tables) -> DataFrame:
    used = t.orders.groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).cast("double").alias("used"))
    left = evidence.budget_left(used, "o_custkey", "used", F.lit(5000.0), F.lit(900000.0))
    return left.join(used, "o_custkey").withColumn("allowed", scores.one_decimal(F.col("allowed") * 100) / 100)


@query("SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value >= 20) WHERE k <= 2")
def latest_two(t: Tables) -> DataFrame:
    return ranked.top(t.events.where("value >= 20"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_type", "ts")


@query("""
SELECT user_id, list_sum([CASE WHEN c > 0 THEN 1 ELSE 0 END, CASE WHEN p > 0 THEN 1 ELSE 0 END])::BIGINT AS kinds FROM (SELECT user_id, count_if(event_type = 'click') AS c, count_if(event_type = 'purchase') AS p FROM events GROUP BY 1)
""")
def merged_kinds(t: Tables) -> DataFrame:
    of = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    every = t.events.groupBy("user_id").agg(F.lit(0).cast("long").alias("n"))
    out = queues.merged_counts({"c": of("click"), "p": of("purchase"), "e": every}, "user_id")
    return out.select("user_id", ((F.col("c") > 0).cast("long") + (F.col("p") > 0).cast("long")).alias("kinds"))
