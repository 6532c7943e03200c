"""Explanations and strategies over orders as matches, whose lines are the skills asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explaining
from ..operators.ranked import spread
from .registry import Tables, query

_STATUSES = ["STRONG", "GAP", "MODERATE", "TRANSFERABLE", "PROJECT", "HISTORICAL", "LISTED"]
_IMPORTANCE = ["required", "preferred", "alternative"]


def matches(t: Tables) -> DataFrame:
    """One row for each order: its skills in the order of parts, and what else a match has."""
    of = lambda values, k: F.get(F.array(*map(F.lit, values)), F.pmod(k, F.lit(len(values))).cast("int"))
    part = F.col("l_partkey")
    lines = spread(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), t.lineitem.count(), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    skill = F.struct(
        part.alias("part"), F.concat(F.lit("T"), part.cast("string")).alias("name"), of(_STATUSES, part).alias("status"), of(_IMPORTANCE, F.floor(part / 7)).alias("importance"), F.lit("near").alias("note"),
        F.array(F.when(F.floor(part / 21) % 2 == 0, "R1").otherwise("D1")).alias("requirement_ids"), F.col("q").alias("weight"),
    )
    skills = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(skill)).alias("skills"))
    k = F.col("o_orderkey")
    return t.orders.join(skills, k == F.col("l_orderkey"), "left").select(
        "o_orderkey", "skills", (k % 100).cast("double").alias("fit"), of(["STRETCH", "MATCH", "OVERQUALIFIED", "UNKNOWN"], k).alias("seniority"), of(["MATCH", "RELOCATION", "UNKNOWN"], k).alias("location"), (F.col("o_orderstatus") == "F").alias("on_target"),
    )


_SKILLS = """
WITH s AS (SELECT l_orderkey AS k, l_partkey AS part, 'T' || l_partkey AS name, ['STRONG', 'GAP', 'MODERATE', 'TRANSFERABLE', 'PROJECT', 'HISTORICAL', 'LISTED'][l_partkey % 7 + 1] AS status, ['required', 'preferred', 'alternative'][l_partkey // 7 % 3 + 1] AS importance, l_partkey // 21 % 2 = 0 AS r, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey),
o AS (SELECT o_orderkey AS k, o_orderkey % 100 AS fit, ['STRETCH', 'MATCH', 'OVERQUALIFIED', 'UNKNOWN'][o_orderkey % 4 + 1] AS seniority, ['MATCH', 'RELOCATION', 'UNKNOWN'][o_orderkey % 3 + 1] AS location, o_orderstatus = 'F' AS on_target FROM orders)"""
_FIRST = "array_to_string(list(name ORDER BY part)[:{0}], ';')"


@query(f"""{_SKILLS},
g AS (SELECT k, CASE WHEN status = 'GAP' AND importance = 'required' AND r THEN 'required gaps' WHEN status = 'GAP' AND importance = 'required' THEN 'duty gaps' WHEN status = 'GAP' AND importance = 'preferred' THEN 'preferred gaps only' WHEN status = 'GAP' THEN 'alternatives' WHEN status = 'PROJECT' AND importance = 'required' THEN 'projects only' WHEN status = 'HISTORICAL' THEN 'not recent' END AS rule, name, part FROM s),
h AS (SELECT k, rule, {_FIRST.format("CASE WHEN rule LIKE '%gaps%' THEN 5 ELSE 4 END")} AS names FROM g WHERE rule IS NOT NULL GROUP BY k, rule)
SELECT k AS o_orderkey, rule, names FROM h WHERE rule <> 'preferred gaps only' OR k NOT IN (SELECT k FROM h WHERE rule IN ('required gaps', 'duty gaps'))
UNION ALL SELECT k, 'transferable', name FROM (SELECT * FROM s WHERE status = 'TRANSFERABLE' QUALIFY row_number() OVER (PARTITION BY k ORDER BY part) <= 2)
UNION ALL SELECT k, 'seniority', seniority FROM o WHERE seniority IN ('STRETCH', 'OVERQUALIFIED') UNION ALL SELECT k, 'location', location FROM o WHERE location = 'RELOCATION' UNION ALL SELECT k, 'focus', '' FROM o WHERE on_target
UNION ALL SELECT k, 'strong all the same', '' FROM o WHERE fit >= 70 AND k IN (SELECT k FROM h WHERE rule IN ('required gaps', 'preferred gaps only'))
""")
def fit_findings(t: Tables) -> DataFrame:
    """Every finding on every match."""
    none = F.array().cast("array<struct<kind: string, status: string, score: double>>")
    found = explaining.findings(F.col("skills"), none, F.col("fit"), F.col("seniority"), F.col("location"), F.col("on_target"), F.lit("Data Engineer"))
    return matches(t).select("o_orderkey", F.explode(found).alias("f")).select("o_orderkey", "f.rule", F.array_join("f.names", ";").alias("names"))


@query(f"""{_SKILLS},
e AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY q DESC, part) AS place FROM s WHERE importance = 'required' AND status IN ('STRONG', 'MODERATE')),
p AS (SELECT k, string_agg(name, ';' ORDER BY place) AS emphasise FROM e WHERE place <= 6 GROUP BY 1),
c AS (SELECT k, part, CASE WHEN status = 'GAP' AND importance = 'required' THEN 'missing' WHEN status = 'TRANSFERABLE' THEN 'transferable' WHEN status = 'HISTORICAL' THEN 'not recent' WHEN status = 'PROJECT' AND importance = 'required' THEN 'projects only' WHEN status = 'LISTED' AND importance = 'required' THEN 'listed only' END AS rule FROM s
      UNION ALL SELECT k, 1000000000, 'seniority' FROM o WHERE seniority = 'STRETCH' UNION ALL SELECT k, 1000000001, 'location' FROM o WHERE location IN ('RELOCATION', 'UNKNOWN')),
d AS (SELECT k, string_agg(rule, ';' ORDER BY part) AS concerns FROM (SELECT * FROM c WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY part) <= 8) GROUP BY 1)
SELECT o.k AS o_orderkey, coalesce(emphasise, '') AS emphasise, 'X0' AS play_down, coalesce(concerns, '') AS concerns FROM o LEFT JOIN p ON p.k = o.k LEFT JOIN d ON d.k = o.k
""")
def strategies(t: Tables) -> DataFrame:
    """What to emphasise, play down and settle in each application."""
    own = F.array(F.struct(F.lit("X0").alias("name"), F.lit("LISTED").alias("level"), F.lit(False).alias("production")))
    made = explaining.strategy(F.col("skills"), F.create_map(F.lit("X0"), F.lit(0.3)), own, F.col("seniority"), F.col("location"))
    names = lambda c, field: F.array_join(F.transform(f"s.{c}", lambda x: x[field]), ";")
    return matches(t).select("o_orderkey", made.alias("s")).select("o_orderkey", names("emphasise", "term").alias("emphasise"), F.array_join("s.play_down", ";").alias("play_down"), names("concerns", "rule").alias("concerns"))
