"""Places and archetypes in texts of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as texts
from ..operators import places, positioning
from .registry import Tables, query

#: SQL for the words of a text.
_WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')"


def benchmark_places(t: Tables) -> DataFrame:
    """The first one to four words of each sentence of the benchmark as names, with their number of letters as place."""
    w = t.benchmark.select(F.explode(F.split("text", r"[.\n]")).alias("s")).select(places.words(F.col("s")).alias("w"))
    heads = w.where("size(w) > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size("w"))), lambda k: F.array_join(F.slice("w", 1, k), " "))).alias("name"))
    return heads.distinct().select("name", F.char_length("name").alias("place"))


@query(f"""
WITH s AS (SELECT {_WORDS.format("unnest(string_split_regex(text, '[.\\n]'))")} AS w FROM benchmark), n AS (SELECT DISTINCT array_to_string(w[:k], ' ') AS name, k FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
d AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS x, unnest(range(1, len({_WORDS.format("text")}) + 1)) AS word FROM documents),
l AS (SELECT *, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4 FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY word)),
g AS (SELECT doc_id, word, 1 AS n, x AS name FROM l UNION ALL SELECT doc_id, word, 2, x || ' ' || x2 FROM l UNION ALL SELECT doc_id, word, 3, x || ' ' || x2 || ' ' || x3 FROM l UNION ALL SELECT doc_id, word, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM l),
m AS (SELECT doc_id, word, g.n, length(name) AS place FROM g JOIN (SELECT DISTINCT name FROM n) USING (name)),
b AS (SELECT doc_id, word, max(n) AS n, arg_max(place, n) AS place FROM m GROUP BY 1, 2),
f AS (SELECT *, coalesce(max(word + n) OVER (PARTITION BY doc_id ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM b)
SELECT doc_id, word::INT AS word, n::INT AS n, place::INT AS place FROM f WHERE word + n > reach
""")
def named_places(t: Tables) -> DataFrame:
    """Names of a gazetteer in all documents, the longest at each place."""
    return places.find_places(t.documents, "doc_id", "text", benchmark_places(t))


def _cities(t: Tables) -> DataFrame:
    """doc_id and three constructed preferences, of a document's words and places."""
    known = F.array(*map(F.lit, ["Bengaluru", "Toronto, Canada", "Remote - UK", "USA", "Nowhere", "united states of x", "Berlin Germany", "Navi Mumbai", "SINGAPORE"]))
    pick = lambda k: F.get(known, F.pmod(k, F.size(known)).cast("int"))
    i, n = F.col("doc_id"), F.coalesce(F.char_length("text"), F.lit(0))
    first = F.get(places.words(F.col("text")), F.lit(0))
    return t.documents.select("doc_id", F.array(F.concat_ws(" ", first, pick(n)), pick(i + n), pick(n * 7 + i)).alias("p"))


_CODES = " ".join(f"WHEN contains(lower(p), '{name}') THEN '{code}'" for name, code, _ in places.COUNTRY_CODES)


@query(f"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, {_WORDS.format("text")}[1] AS w, ['Bengaluru', 'Toronto, Canada', 'Remote - UK', 'USA', 'Nowhere', 'united states of x', 'Berlin Germany', 'Navi Mumbai', 'SINGAPORE'] AS c FROM documents),
l AS (SELECT doc_id, unnest([concat_ws(' ', w, c[n % 9 + 1]), c[(doc_id + n) % 9 + 1], c[(n * 7 + doc_id) % 9 + 1]]) AS p, unnest([1, 2, 3]) AS pos FROM d),
h AS (SELECT doc_id, pos, CASE {_CODES} WHEN regexp_matches(p, '{names.INDIA}') THEN 'IND' END AS code FROM l), f AS (SELECT doc_id, code, min(pos) AS pos FROM h WHERE code IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, coalesce(string_agg(code, ';' ORDER BY pos), '') AS codes FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id
""")
def location_hints(t: Tables) -> DataFrame:
    hints = places.country_hints(F.col("p"), names.INDIA)
    return _cities(t).select("doc_id", F.array_join(F.transform(hints, lambda h: h["code"]), ";").alias("codes"))


def _vectors(t: Tables) -> DataFrame:
    """doc_id, term, weight: how often a document has each of its words."""
    rows = t.documents.select("doc_id", F.explode(places.words(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("weight"))


def _label_sets(t: Tables) -> DataFrame:
    """label, term, weight: the words of the benchmark, dealt over five labels, the longer the heavier."""
    rows = t.benchmark.select((F.col("item_id") % 5).alias("k"), F.explode(F.array_distinct(places.words(F.col("text")))).alias("term")).distinct()
    return rows.select(F.concat(F.lit("label-"), F.col("k").cast("string")).alias("label"), "term", (F.char_length("term") / 8.0).alias("weight"))


@query(f"""
WITH v AS (SELECT doc_id, term, count(*)::DECIMAL(18, 6) AS a FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents) GROUP BY 1, 2),
l AS (SELECT DISTINCT 'label-' || item_id % 5 AS label, unnest({_WORDS.format("text")}) AS term FROM benchmark), w AS (SELECT label, term, (length(term) / 8.0)::DECIMAL(18, 6) AS b FROM l),
s AS (SELECT doc_id, label, sum(a * b) AS s FROM v JOIN w USING (term) GROUP BY 1, 2)
SELECT doc_id, arg_min(label, (-s, label)) AS label, max(s)::DOUBLE AS score FROM s GROUP BY 1
""")
def document_labels(t: Tables) -> DataFrame:
    return positioning.nearest_label(_vectors(t), "doc_id", _label_sets(t))


def _hints(t: Tables) -> DataFrame:
    """Words of the benchmark as hints at the four archetypes."""
    order = list(positioning.ARCHETYPES)
    rows = t.benchmark.select((F.col("item_id") % 4).cast("int").alias("rank"), F.explode(F.split(texts.normalize_text(F.col("text")), " ")).alias("alias")).where("length(alias) > 6").distinct()
    return rows.select(F.get(F.array(*map(F.lit, order)), F.col("rank")).alias("archetype"), "rank", "alias")


@query()
def positioned_documents(t: Tables) -> DataFrame:
    """The archetype of each document by its first line and its text, and the terms that it brings forward."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    both = F.array(F.struct(F.lit("first line").alias("source"), F.lit(0).alias("rank"), first.alias("text")), F.struct(F.lit("text").alias("source"), F.lit(1).alias("rank"), F.col("text").alias("text")))
    kinds = positioning.archetypes(t.documents.select("doc_id", F.inline(both)), "doc_id", _hints(t))
    company = F.get(F.array(*map(F.lit, ["amazon", "microsoft", "uber", "databricks"])), (F.col("doc_id") % 7).cast("int"))
    rows = t.documents.select("doc_id", company.alias("company")).join(kinds, "doc_id", "left")
    profiles = positioning.signal_table(t.spark, {k.lower(): v for k, v in positioning.PROFILES.items()}, "company")
    styles = positioning.signal_table(t.spark, positioning.ARCHETYPES, "archetype")
    boosts = positioning.positions(rows, "doc_id", profiles, styles, positioning.term_table(t.spark))[1]
    made = boosts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "boost"))).alias("b"))
    listed = F.array_join(F.transform("b", lambda x: F.concat_ws("=", x["term"], x["boost"].cast("string"))), ";")
    return rows.join(made, "doc_id", "left").select("doc_id", "archetype", "source", "hint", F.coalesce(listed, F.lit("")).alias("boosts"))
