"""Hiring signals and similar companies over pages, whose words stand for names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import signals
from ..operators.ranked import once
from .registry import Tables, query

_ROLES = ["Senior Data Engineer", "Data Analyst", "Platform Engineer", "ETL Developer", "Nurse", "Software Engineer, Data"]


def _of(values: list[Column | str], key: Column) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def page_results(t: Tables) -> DataFrame:
    """Every page as a search result: its own title, words, host and text, in the forms that result titles have."""
    i = F.col("page_id")
    title, body = F.coalesce(text.page_title(F.col("html")), F.lit("")), text.html_to_text(F.col("html"), 400)
    # What the forms are made of is found once a page.
    rows = once(t.pages, ["page_id", "url"], own=title, body=body)
    words = F.filter(F.split(F.regexp_replace("own", r"[^\p{L}]+", " "), " "), lambda w: F.char_length(w) > 1)
    rows = once(rows, ["page_id", "url", "own", "body"], words=words)
    label = F.lower(F.regexp_replace(F.concat_ws("-", F.get("words", F.lit(0)), F.get("words", F.lit(1))), "[^A-Za-z0-9-]", ""))
    rows = once(rows, ["page_id", "url", "own", "body", "words"], name=F.initcap(F.array_join(F.slice("words", 1, 2), " ")), label=label)
    words, name, role, label = F.col("words"), F.col("name"), _of(_ROLES, F.floor(i / 12)), F.col("label")
    forms = [
        F.concat_ws(" | ", role, name, F.lit("Careers")), F.concat(name, F.lit(" hiring "), role, F.lit(" in Pune, India | LinkedIn")), F.concat(F.lit("Job Application for "), role, F.lit(" at "), name), F.concat(role, F.lit(" - "), name, F.lit(" Jobs - Berlin")),
        F.col("own"), F.concat(name, F.lit(" is hiring a "), role), F.concat(F.lit("1,200+ "), name, F.lit(" "), role, F.lit(" jobs in India")), F.concat(role, F.lit(" at "), name, F.lit(", in Pune")),
        F.concat(role, F.lit(" &amp; Remote")), F.concat(F.lit("Careers at "), name, F.lit(" : "), role), F.concat(role, F.lit(", "), name, F.lit(", London")), role,
    ]
    hosts = [
        F.concat(F.lit("https://boards.greenhouse.io/"), label, F.lit("/jobs/"), i.cast("string")), F.lit("https://www.linkedin.com/jobs/view/1"), F.concat(F.lit("https://jobs.lever.co/"), label), F.concat(F.lit("https://www.indeed.com/jobs?q="), label), F.lit("https://x.com/a/status/1"),
        F.concat(F.lit("https://"), F.replace(label, F.lit("-"), F.lit("")), F.lit(".com/careers/jobs/7")), F.concat(F.lit("https://careers."), F.replace(label, F.lit("-"), F.lit("")), F.lit(".co.uk/en")), F.col("url"), F.concat("url", F.lit("/jobs/9?gh_jid=2")), F.lit("mailto:a@b"), F.lit("https://in.linkedin.com/jobs/data"),
    ]
    snippet = F.when(i % 4 == 0, F.concat(name, F.lit(" is hiring. We are hiring a "), role, F.lit(" at "), name, F.lit(". "), "body")).when(i % 4 == 1, F.concat("body", F.lit(" Data Engineer wanted"))).otherwise(F.col("body"))
    return rows.select("page_id", _of(forms, i).alias("title"), _of(hosts, i).alias("url"), snippet.alias("snippet"), name.alias("name"), words.alias("words"))


@query()
def page_signals(t: Tables) -> DataFrame:
    """The rule that fired for each page and its signal."""
    return signals.signals(page_results(t), "page_id", "title", "url", "snippet")


@query()
def similar_companies(t: Tables) -> DataFrame:
    """Names that the pages' texts list beside a company, built of their own words."""
    rows = page_results(t)
    some = F.array_join(F.transform(F.slice(F.col("words"), 2, 9), lambda x: F.initcap(x)), ", ")
    lead = _of(["Top competitors of Acme include ", "Rivals include ", "It competes with ", "Companies like Acme include ", "We know of "], F.col("page_id"))
    listed = F.concat(lead, some, F.lit(" and "), "name", F.lit(", etc. More text."))
    return signals.similar_companies(rows.withColumn("listed", listed), "page_id", "name", "title", "listed")
