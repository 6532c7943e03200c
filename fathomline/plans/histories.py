"""Funnels, evidence and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, funnel, listing, ranked
from .registry import Tables, query, ts

STAGES = {"applied": ["click", "purchase", "signup"], "responded": ["purchase", "signup"], "interviewed": ["signup"], "offered": ["purchase"]}
_REACHED = """
WITH r AS (SELECT user_id, bool_or(event_type IN ('click', 'purchase', 'signup')) AS applied, bool_or(event_type IN ('purchase', 'signup')) AS responded, bool_or(event_type = 'signup') AS interviewed, bool_or(event_type = 'purchase') AS offered
  FROM events GROUP BY user_id)
"""


def _reached(t: Tables) -> DataFrame:
    return funnel.reached(t.events, "user_id", "event_type", STAGES)


@query(_REACHED + """
SELECT count(*) AS tracked, count_if(applied) AS applied, count_if(applied AND responded) AS responses, count_if(applied AND interviewed) AS interviews, count_if(applied AND offered) AS offers,
  CASE WHEN count_if(applied) > 0 THEN round((100.0 * count_if(applied AND interviewed)::DOUBLE / count_if(applied))::DECIMAL(20, 6), 1)::DOUBLE END AS interview_rate FROM r
""")
def funnel_totals(t: Tables) -> DataFrame:
    return funnel.totals(_reached(t), "applied", "responded", "interviewed", "offered")


@query(_REACHED + """
, d AS (SELECT *, unnest([{'dimension': 'tier', 'value': 'T' || user_id % 7}, {'dimension': 'region', 'value': CASE WHEN user_id % 5 = 0 THEN '' ELSE 'R' || user_id % 5 END}, {'dimension': 'parity', 'value': 'even'}, {'dimension': 'parity', 'value': CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'odd' END}], recursive := true) FROM r WHERE applied)
SELECT dimension, coalesce(nullif(value, ''), 'UNKNOWN') AS value, count(*) AS applications, count_if(responded) AS responses, count_if(interviewed) AS interviews,
  round((100.0 * count_if(interviewed)::DOUBLE / count(*))::DECIMAL(20, 6), 1)::DOUBLE AS interview_rate, count(*) < 5 AS low_sample FROM d GROUP BY 1, 2
""")
def funnel_by_dimension(t: Tables) -> DataFrame:
    u = F.col("user_id")
    name = lambda p, n: F.concat(F.lit(p), (u % n).cast("string"))
    dimensions = {"tier": name("T", 7), "region": F.when(u % 5 == 0, "").otherwise(name("R", 5)), "parity": F.array(F.lit("even"), F.when(u % 2 != 0, "odd"))}
    return funnel.breakdown(_reached(t), dimensions, "applied", "responded", "interviewed")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_per_key(t: Tables) -> DataFrame:
    return ranked.latest(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id", "value"])


@query("""
WITH d AS (SELECT user_id, arg_max(event_type = 'signup', (ts, event_id)) AS a FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1)
SELECT u.user_id, coalesce(a, false) AS approved FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN d USING (user_id)
""")
def approval_state(t: Tables) -> DataFrame:
    return funnel.approved(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error")


@query("""
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, run::BIGINT AS run, count(*) AS length, min(ts) AS first_at, max(ts) AS last_at FROM r WHERE event_type = 'error' GROUP BY 1, 2
""")
def consecutive_failures(t: Tables) -> DataFrame:
    return ranked.runs_of(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


@query("""
SELECT sha256(user_id || '|' || event_type) AS fingerprint, count(*) AS observations, max(value) AS confidence, arg_max(event_id, (ts, event_id)) AS evidence, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id, event_type
""")
def evidence_upsert(t: Tables) -> DataFrame:
    """The state after the first half of the month, merged with the rest."""
    rows = evidence.observed(t.events, text.fingerprint(F.col("user_id"), F.col("event_type")), F.col("value"), F.col("event_id"), F.col("ts"))
    cut = ts("2024-01-15 00:00:00")
    state = evidence.merge_evidence(None, rows.where(F.col("first_seen") < cut))
    return evidence.merge_evidence(state, rows.where(F.col("first_seen") >= cut))


@query("""
WITH b AS (SELECT user_id, event_type, max(greatest(0, least(value / 500, 0.99))) AS c FROM events GROUP BY 1, 2)
SELECT user_id, round(least(0.99, 1 - product(1 - c)), 9) AS joint_confidence FROM b GROUP BY 1
""")
def noisy_or_confidence(t: Tables) -> DataFrame:
    rows = t.events.withColumn("confidence", F.col("value") / 500)
    return evidence.noisy_or(rows, "user_id", ["event_type"], "confidence").withColumn("joint_confidence", F.round("joint_confidence", 9))


@query("""
WITH w AS (SELECT lang, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM w WHERE term <> '' GROUP BY 1, 2)
SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 12
""")
def top_k_terms(t: Tables) -> DataFrame:
    words = t.documents.select("lang", F.explode(F.split(text.normalize_text(F.col("text")), " ")).alias("term")).where("term <> ''")
    return ranked.top_terms(words, "lang", "term", 12).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT user_id, 'k' AS name, sum((props::JSON->>'k')::DOUBLE) AS total FROM events GROUP BY user_id")
def json_map_sum(t: Tables) -> DataFrame:
    return evidence.sum_json_map(t.events, "props", ["user_id"])


@query("""
WITH m AS (SELECT user_id, sum(value::DECIMAL(18, 2))::DOUBLE AS used FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, greatest(0, least(300, 1000 - used)) AS allowed FROM m
""")
def budget_left(t: Tables) -> DataFrame:
    used = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("used"))
    return evidence.budget_left(used, "user_id", "used", F.lit(300.0), F.lit(1000.0))


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS heading FROM conversations
""")
def heading_carry(t: Tables) -> DataFrame:
    carried = ranked.carried(t.conversations, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("text")), "heading")
    return carried.select("conv_id", "turn", "role", "heading")


@query("""
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3
""")
def tumbling_windows(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")


@query("""
WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 12 HOUR AS window_end, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3
""")
def sliding_windows(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")


@query("""
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


@query("""
WITH s AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2)
SELECT user_id, event_type FROM s ORDER BY ts, user_id, event_type LIMIT 20
""")
def fifo_claims(t: Tables) -> DataFrame:
    """The oldest waiting entries, in order of arrival."""
    rows = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    return listing.page(rows, [F.asc("ts"), F.asc("user_id"), F.asc("event_type")], 20).select("user_id", "event_type")
