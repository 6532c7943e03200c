"""Feeds and search results as signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, jobs, text
from ..operators.companies import name_key
from ..operators.listing import small
from ..operators.ranked import top

#: Labels of a dataset of startups that speak for data work.
DATA_TAGS = ["data engineering", "databases", "analytics", "infrastructure", "developer tools", "fintech", "payments", "machine learning", "artificial intelligence", "ai", "b2b", "saas", "big data", "cloud computing", "open source", "security", "observability", "devops", "data visualization", "enterprise software", "banking and exchange", "insurance", "credit and lending", "enterprise"]
DATA_TEXT = r"\b(data|analytics|database|warehouse|pipelines?|streaming|infrastructure|platform|api|payments?|lending|fintech|machine learning|ml|ai)\b"


def hiring_threads(stories: DataFrame, now: Column, most_days: int = 45) -> DataFrame:
    """The newest thread that asks who is hiring, if it is not too old."""
    asked = stories.where(F.lower("title").startswith("ask hn: who is hiring"))
    newest = asked.select(F.max(F.struct("created_at", "id", "title")).alias("s")).select("s.*")
    return newest.where(F.datediff(now, F.col("created_at")) <= most_days)


def hiring_posts(comments: DataFrame, thread: DataFrame) -> DataFrame:
    """Top-level comments of the thread as signals: company, role and place from the first line's segments.

    `comments` has object_id, parent_id, created_at, html. Posts without a target
    role are left out, repeated ones count once.
    """
    rows = comments.join(small(thread.select(F.col("id").alias("parent_id"))), "parent_id").dropDuplicates(["object_id"])
    line = F.split_part(text.html_to_text(F.col("html"), 4000), F.lit("\n"), F.lit(1))
    parts = F.transform(F.split(line, r"\s*\|\s*"), lambda p: F.trim(p))
    rows = rows.select("object_id", "created_at", line.alias("line"), F.get(parts, F.lit(0)).alias("company"), F.posexplode(F.slice(parts, 2, 20)).alias("place", "segment"))
    role = jobs.classify_role(F.col("segment"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = rows.withColumns({"role": role, "remote": jobs.remote_status(F.col("line"))})
    hit = rows.where(jobs.is_target(F.col("role.category"), F.col("role.relevance")))
    found = top(hit, ["object_id"], [F.asc("place")]).where("company <> ''")
    return found.select("object_id", "company", name_key(F.col("company")).alias("company_key"), F.col("segment").alias("role_title"), F.col("role.relevance").alias("role_relevance"), "remote", "created_at")


def listings(rows: DataFrame, most: int) -> DataFrame:
    """The newest target roles of a remote-work listing (id, company, title, url, published)."""
    role = jobs.classify_role(F.col("title"), F.lit(None).cast("string"), F.col("company"))
    kept = rows.withColumns({"role": role, "posted": dates.parse_posted(F.col("published"))}).where(jobs.is_target(F.col("role.category"), F.col("role.relevance")))
    return kept.select("id", "company", "title", "url", F.col("posted.value").alias("posted_at"), F.col("role.relevance").alias("role_relevance")).orderBy(F.desc_nulls_last("posted_at"), "id").limit(most)


def startups(rows: DataFrame, known: DataFrame, regions: list[str], most: int) -> DataFrame:
    """Hiring startups of the regions that are not known yet, the best by labels, size and place.

    `rows` has name, status, is_hiring, regions, industries, tags (arrays),
    one_liner, team_size; `known` has company_key.
    """
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    labels = F.array_union(low(F.col("industries")), low(F.col("tags")))
    rows = rows.withColumns({"company_key": name_key(F.col("name")), "tag_matches": F.size(F.array_intersect(labels, F.array(*(F.lit(t) for t in DATA_TAGS)))), "text_match": F.coalesce(F.lower("one_liner").rlike(DATA_TEXT), F.lit(False))})
    team = F.coalesce("team_size", F.lit(0))
    fit = F.coalesce("is_hiring", F.lit(False)) & (F.coalesce("status", F.lit("Active")) == "Active") & F.arrays_overlap(low(F.col("regions")), F.array(*(F.lit(r.lower()) for r in regions)))
    wanted = rows.where(fit & ((F.col("tag_matches") > 0) | F.col("text_match")) & ((team == 0) | (team >= 15)) & (F.col("company_key") != "")).join(known.select("company_key"), "company_key", "left_anti")
    at = lambda r: F.array_contains("regions", r).cast("int")
    score = 3 * at("India") + at("Remote") + F.least(F.col("tag_matches"), F.lit(4)) + 2 * F.col("text_match").cast("int") + 2 * (team >= 50).cast("int") + (team >= 200).cast("int")
    return wanted.withColumn("score", score).orderBy(F.desc("score"), "name").limit(most)


def cached_results(results: DataFrame, now: Column, hours: float = 6, most: int = 50) -> DataFrame:
    """Of each query the rows of its newest fetch, if that is recent; at most `most` by rank."""
    recent = results.where(dates.hours_between(F.col("fetched_at"), now) <= hours)
    newest = recent.groupBy("query").agg(F.max("fetched_at").alias("fetched_at"))
    return top(recent.join(newest, ["query", "fetched_at"]), ["query"], [F.asc("rank"), F.asc("url")], most)


def first_provider(results: DataFrame, priority: list[str], blocked: list[str]) -> DataFrame:
    """Of each query the results of the first provider in order that has any and isn't blocked; each URL once."""
    order = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("provider"))
    usable = results.withColumn("_o", order).where((F.col("_o") > 0) & ~F.col("provider").isin(*blocked or [""]))
    first = usable.groupBy("query").agg(F.min("_o").alias("_o"))
    rows = usable.join(first, ["query", "_o"]).drop("_o").withColumn("url", text.canonical_url(F.col("url")))
    return top(rows, ["query", "url"], [F.asc("rank")])
