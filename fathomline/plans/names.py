"""Names of tables found in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gazetteer
from .registry import Tables, query


def benchmark_names(t: Tables) -> DataFrame:
    """Words of five letters or more of the benchmark, its pairs of neighbouring words, and two names with guards."""
    words = F.split(text.normalize_text(F.col("text")), " ")
    rows = t.benchmark.select(words.alias("w"))
    single = rows.select(F.explode("w").alias("alias")).where(F.char_length("alias") >= 5)
    pairs = rows.where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).alias("alias"))
    known = single.unionByName(pairs).distinct().select(F.col("alias").alias("term"), "alias", F.array().cast("array<string>").alias("not_after"), F.array().cast("array<string>").alias("not_before"))
    guarded = t.spark.createDataFrame([("SQL", "sql", ["/"], [" server"]), ("Token", "token", ["csrf "], [])], known.schema)
    return known.unionByName(guarded)


#: Texts as runs of letters and what stands between them, each with its place; names are one run, or two with a space between.
_TERMS = """
WITH w AS (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
n AS (SELECT DISTINCT name FROM (SELECT unnest(w) AS name FROM w) WHERE length(name) >= 5 UNION SELECT DISTINCT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+#]+|[^A-Za-z0-9+#]+')) AS run, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9+#]+|[^A-Za-z0-9+#]+')))) AS i FROM documents),
p AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS place, coalesce(lag(run) OVER o, '') AS before, coalesce(lag(run, 2) OVER o, '') AS second_before, coalesce(lead(run) OVER o, '') AS after, coalesce(lead(run, 2) OVER o, '') AS second FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT *, lower(run) AS one, CASE WHEN after = ' ' THEN lower(run) || ' ' || lower(second) END AS two FROM p WHERE regexp_matches(run, '^[A-Za-z0-9+#]') AND NOT ends_with(before, '-')),
d AS (SELECT doc_id, i, place, two AS term FROM t WHERE two IN (SELECT name FROM n)),
s AS (SELECT doc_id, i, place, one AS term FROM t WHERE one IN (SELECT name FROM n)
      UNION SELECT doc_id, i, place, 'SQL' FROM t WHERE one = 'sql' AND NOT ends_with(before, '/') AND NOT (after = ' ' AND starts_with(lower(second), 'server'))
      UNION SELECT doc_id, i, place, 'Token' FROM t WHERE one = 'token' AND NOT (before = ' ' AND ends_with(lower(second_before), 'csrf'))),
h AS (SELECT * FROM d UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = s.doc_id AND (d.i = s.i OR d.i = s.i - 2)))
SELECT doc_id, term, min(place)::INT AS start, count(*)::INT AS n FROM h GROUP BY 1, 2
"""


@query(_TERMS)
def benchmark_terms(t: Tables) -> DataFrame:
    """The benchmark's words and pairs in all documents: the first place and the number of each; a word within a pair found there doesn't count."""
    found = gazetteer.find_names(t.documents, "doc_id", "text", benchmark_names(t))
    return found.select("doc_id", F.explode("terms").alias("t")).select("doc_id", F.col("t.name").alias("term"), "t.start", "t.n")
