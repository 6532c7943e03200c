"""URL filters: host-suffix and path-prefix expressions against a table of rules.

Each URL is expanded into (host suffix, path prefix) expressions. They meet the
rules by an equi-join on the first 32 bits of a SHA-256 digest; the whole digest
and the rule's path then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

#: Up to so many rules are broadcast, beyond it they are shuffled; a rule takes some 200 bytes.
BROADCAST_RULES = 100_000
SALTS = 64

#: Fixed values of the contract: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z in lower case; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column, depth: int) -> Column:
    """The host and its parents of at most `depth` labels."""
    labels = F.split(host, r"\.", -1)
    n = F.least(F.size(labels), F.lit(depth))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))


def _prefixes(path: Column, depth: int) -> Column:
    """The path up to each of its first `depth` slashes, and "" for rules without a slash."""
    parts = F.split(path, "/", -1)
    n = F.least(F.size(parts) - 1, F.lit(depth))
    cuts = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), F.when(n > 0, cuts).otherwise(F.array().cast("array<string>")))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of `pages`: page_id, url, host, path, rule (null if none fits), verdict.

    `rules` has verdict, host, path. A rule fits its host and all subdomains
    where the URL's path starts with the rule's. The longest host and path win,
    then the longer host, then block. A null URL and one without :// have an
    empty host and path, and get `default` unless a rule fits those. Repeated
    rows are judged each; other columns of `pages` are not returned.
    """
    rules = rules.select(F.coalesce(F.col("verdict"), F.lit(default)).alias("_verdict"), F.coalesce(F.lower("host"), F.lit("")).alias("_rule_host"), F.coalesce("path", F.lit("")).alias("_rule_path")).distinct()
    rules = rules.withColumn("_key", F.concat("_rule_host", F.lit(" "), F.regexp_extract("_rule_path", r"(?s)^(.*/)?", 0)))
    rules = rules.withColumn("_digest", F.sha2("_key", 256)).withColumn("_short", F.substring("_digest", 1, 8)).drop("_key")
    # Bounded facts about the rules: how many there are, and their deepest host and path.
    n, labels, slashes = rules.agg(F.count("*"), F.max(F.size(F.split("_rule_host", r"\.", -1))), F.max(F.size(F.split("_rule_path", "/", -1)) - 1)).first()

    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("_row"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    pairs = F.flatten(F.transform(_suffixes(F.col("host"), labels or 1), lambda h: F.transform(_prefixes(F.col("path"), slashes or 0), lambda p: F.sha2(F.concat(h, F.lit(" "), p), 256))))
    tried = urls.withColumn("_tried", F.explode(pairs)).withColumn("_short_tried", F.substring("_tried", 1, 8))
    if n <= BROADCAST_RULES:
        on, side = F.col("_short_tried") == F.col("_short"), F.broadcast(rules)
    else:  # a common expression is dealt over the salts, each of which has all rules
        tried = tried.withColumn("_salt_tried", F.pmod("_row", F.lit(SALTS)))
        side = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = (F.col("_short_tried") == F.col("_short")) & (F.col("_salt_tried") == F.col("_salt"))
    on = on & (F.col("_tried") == F.col("_digest")) & F.expr("startswith(path, _rule_path)")
    rank = F.struct(F.length("_rule_host") + F.length("_rule_path"), F.length("_rule_host"), (F.col("_verdict") == "block").cast("int"), F.concat("_rule_host", "_rule_path").alias("rule"), F.col("_verdict").alias("verdict"))
    best = tried.join(side, on, "left").groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("page_id", "url", "host", "path")),
        F.max(F.when(F.col("_digest").isNotNull(), rank)).alias("_best"),
    )
    return best.select("page_id", "url", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL by RULES; judge_urls says what holds for null and odd URLs."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(read(spark, sf_dir, "pages"), rules).drop("url")


ORACLE = """
WITH r(verdict, h, p) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
u AS (
  SELECT row_number() OVER () AS i, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
m AS (
  SELECT u.*, r.verdict, h || p AS rule, row_number() OVER (PARTITION BY i ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
