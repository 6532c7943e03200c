"""Payloads of job boards as postings.

A landing row is one payload: `payload` (JSON text) and `company`. All readers
return the columns of POSTING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, jobs, text
from . import markup

POSTING = ["company", "title", "location", "remote_status", "salary", "employment_type", "application_url", "source_url", "source", "ats", "external_id", "posted_at", "posted_at_precision", "source_updated_at", "description"]

_GREENHOUSE = "struct<jobs:array<struct<id:string,title:string,absolute_url:string,company_name:string,location:struct<name:string>,first_published:string,updated_at:string,content:string>>>"
_LEVER = "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:string,workplaceType:string,description:string,descriptionPlain:string,additional:string,additionalPlain:string,categories:struct<location:string,allLocations:array<string>,commitment:string>,lists:array<struct<text:string,content:string>>,salaryRange:struct<currency:string,min:string,max:string,interval:string>>>"
_ASHBY = "struct<jobs:array<struct<id:string,title:string,jobUrl:string,applyUrl:string,isListed:boolean,isRemote:boolean,workplaceType:string,location:string,secondaryLocations:array<struct<location:string>>,employmentType:string,publishedAt:string,descriptionPlain:string,descriptionHtml:string,compensation:struct<compensationTierSummary:string>>>>"
_RECRUITEE = "struct<offers:array<struct<id:string,title:string,careers_url:string,careers_apply_url:string,status:string,remote:boolean,location:string,employment_type_code:string,published_at:string,description:string,requirements:string>>>"
_WORKDAY = "struct<listing:struct<jobPostings:array<struct<title:string,externalPath:string,postedOn:string,locationsText:string>>>,host:string,site:string,fetched_on:string>"
_AMAZON = "struct<jobs:array<struct<id_icims:string,title:string,posted_date:string,description:string,basic_qualifications:string,normalized_location:string,job_path:string,job_schedule_type:string>>>"


def _known(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _posting(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    rows = df.withColumn("_posted", dates.parse_posted(columns.pop("posted", F.lit(None).cast("string"))))
    updated = dates.parse_posted(columns.pop("updated", F.lit(None).cast("string")))["value"]
    fixed = {
        "source": F.lit(source),
        "ats": F.lit(source),
        "external_id": text.bounded_id(columns.pop("id")),
        "posted_at": F.col("_posted.value"),
        "posted_at_precision": F.col("_posted.precision"),
        "source_updated_at": updated,
    }
    every = {c: F.lit(None).cast("string") for c in POSTING} | fixed | columns
    return rows.select(*(every[c].alias(c) for c in POSTING))


def _items(df: DataFrame, schema: str, path: str | None) -> DataFrame:
    parsed = F.from_json("payload", schema)
    return df.select("company", F.explode(parsed[path] if path else parsed).alias("j"))


def greenhouse(landing: DataFrame) -> DataFrame:
    """The time of first publication is the posting time; edits only set source_updated_at."""
    rows = _items(landing, _GREENHOUSE, "jobs")
    place = F.coalesce(_known(F.col("j.location.name")), F.lit("Unknown"))
    return _posting(rows, "greenhouse", id=F.col("j.id"), company=F.coalesce("j.company_name", "company"), title=F.col("j.title"), location=place, remote_status=jobs.remote_status(place), application_url=F.col("j.absolute_url"), source_url=F.col("j.absolute_url"), posted=F.col("j.first_published"), updated=F.col("j.updated_at"), description=text.html_to_text(F.col("j.content")))


def lever(landing: DataFrame) -> DataFrame:
    rows = _items(landing, _LEVER, None)
    place = F.coalesce(_known(F.col("j.categories.location")), _known(F.array_join("j.categories.allLocations", ", ")), F.lit("Unknown"))
    heads = F.transform("j.lists", lambda e: F.coalesce(e["text"], F.lit("")))
    lists = F.array_join(F.zip_with(heads, text.html_to_texts(F.col("j.lists.content")), lambda h, c: F.concat_ws("\n", h, c)), " ")
    parts = [F.coalesce(_known(F.col(f"j.{p}Plain")), _known(text.html_to_text(F.col(f"j.{p}")))) for p in ("description", "additional")]
    pay = F.col("j.salaryRange")
    salary = F.when(pay["min"].isNotNull() & pay["max"].isNotNull(), F.trim(F.concat_ws(" ", pay["currency"], F.concat_ws("-", pay["min"], pay["max"]), pay["interval"])))
    return _posting(rows, "lever", id=F.col("j.id"), company=F.col("company"), title=F.col("j.text"), location=place, remote_status=jobs.remote_status(place, F.col("j.workplaceType")), employment_type=F.col("j.categories.commitment"), salary=salary, application_url=F.coalesce("j.applyUrl", "j.hostedUrl"), source_url=F.col("j.hostedUrl"), posted=F.col("j.createdAt"), description=F.concat_ws("\n", parts[0], _known(lists), parts[1]))


def ashby(landing: DataFrame) -> DataFrame:
    """Unlisted jobs are left out; secondary locations follow the first, each once."""
    rows = _items(landing, _ASHBY, "jobs").where(F.coalesce("j.isListed", F.lit(True)))
    more = F.coalesce(F.transform("j.secondaryLocations", lambda x: x["location"]), F.array().cast("array<string>"))
    places = F.array_distinct(F.filter(F.concat(F.array("j.location"), more), lambda x: F.coalesce(x, F.lit("")) != ""))
    place = F.substring(F.coalesce(_known(F.array_join(places, "; ")), F.lit("Unknown")), 1, 300)
    remote = F.when(F.col("j.isRemote"), "remote").otherwise(jobs.remote_status(place, F.col("j.workplaceType")))
    return _posting(rows, "ashby", id=F.col("j.id"), company=F.col("company"), title=F.col("j.title"), location=place, remote_status=remote, employment_type=F.col("j.employmentType"), salary=F.col("j.compensation.compensationTierSummary"), application_url=F.coalesce("j.applyUrl", "j.jobUrl"), source_url=F.col("j.jobUrl"), posted=F.col("j.publishedAt"), description=F.coalesce(_known(F.col("j.descriptionPlain")), text.html_to_text(F.col("j.descriptionHtml"))))


def recruitee(landing: DataFrame) -> DataFrame:
    """Offers without status and published ones."""
    rows = _items(landing, _RECRUITEE, "offers").where(F.coalesce("j.status", F.lit("published")) == "published")
    place = F.coalesce(_known(F.col("j.location")), F.lit("Unknown"))
    remote = F.when(F.col("j.remote"), "remote").otherwise(jobs.remote_status(place))
    body = F.concat_ws("\n", _known(text.html_to_text(F.col("j.description"))), _known(text.html_to_text(F.col("j.requirements"))))
    return _posting(rows, "recruitee", id=F.col("j.id"), company=F.col("company"), title=F.col("j.title"), location=place, remote_status=remote, employment_type=F.col("j.employment_type_code"), application_url=F.coalesce("j.careers_apply_url", "j.careers_url"), source_url=F.col("j.careers_url"), posted=F.col("j.published_at"), description=body)


def workday(landing: DataFrame, details: DataFrame) -> DataFrame:
    """Listings, each path once, with the details that were fetched for them.

    `details` has path and payload (the posting's JSON). Searches never list
    everything, so these scans are not complete.
    """
    parsed = F.from_json("payload", _WORKDAY)
    rows = landing.select("company", parsed.alias("p")).select("company", "p.host", "p.site", "p.fetched_on", F.explode("p.listing.jobPostings").alias("j"))
    rows = rows.groupBy(F.col("j.externalPath").alias("path")).agg(F.min(F.struct("company", "host", "site", "fetched_on", "j")).alias("r")).select("path", "r.*")
    info = F.from_json("payload", "struct<jobPostingInfo:struct<title:string,jobDescription:string,location:string,startDate:string,jobReqId:string,externalUrl:string,timeType:string>>")["jobPostingInfo"]
    rows = rows.join(details.select("path", info.alias("d")), "path", "left")
    place = F.coalesce(_known(F.col("d.location")), _known(F.col("j.locationsText")), F.lit("Unknown"))
    url = F.coalesce("d.externalUrl", F.concat(F.lit("https://"), "host", F.lit("/"), "site", "path"))
    posted = F.coalesce("d.startDate", dates.days_ago(F.col("j.postedOn"), F.col("fetched_on").try_cast("date")).cast("string"))
    return _posting(rows, "workday", id=F.coalesce("d.jobReqId", "path"), company=F.col("company"), title=F.coalesce("d.title", "j.title"), location=place, remote_status=jobs.remote_status(place), employment_type=F.col("d.timeType"), application_url=url, source_url=url, posted=posted, description=text.html_to_text(F.col("d.jobDescription")))


def amazon(landing: DataFrame) -> DataFrame:
    """Scoped searches before the global one (`scope`, ascending): a job's first result counts."""
    rows = landing.select("company", "scope", F.explode(F.from_json("payload", _AMAZON)["jobs"]).alias("j"))
    rows = rows.groupBy("j.id_icims").agg(F.min(F.struct("scope", "company", "j")).alias("r")).select("r.company", "r.j")
    place = F.coalesce(_known(F.col("j.normalized_location")), F.lit("Unknown"))
    url = F.concat(F.lit("https://www.amazon.jobs"), "j.job_path")
    body = F.concat_ws("\n", _known(text.html_to_text(F.col("j.description"))), _known(text.html_to_text(F.col("j.basic_qualifications"))))
    return _posting(rows, "amazon_jobs", id=F.col("j.id_icims"), company=F.col("company"), title=F.col("j.title"), location=place, remote_status=jobs.remote_status(place), employment_type=F.col("j.job_schedule_type"), application_url=url, source_url=url, posted=F.col("j.posted_date"), description=body)


READERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "recruitee": recruitee}


def scan_status(scans: DataFrame) -> DataFrame:
    """One status for each scan: errors and blocks before everything, and complete only if all went well."""
    status = F.when(F.col("http_status").isin(401, 403, 429), "BLOCKED").when(F.col("http_status").isin(404, 410), "NOT_FOUND").when((F.col("http_status") >= 400) | F.col("http_status").isNull(), "ERROR").when(F.col("errors") > 0, "PARTIAL").otherwise("OK")
    return scans.withColumn("status", status).withColumn("complete", (F.col("status") == "OK") & F.coalesce("enumerated", F.lit(False)))


def links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Absolute links of pages, each once per page, with their label and place."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return markup.links(markup.elements(pages, id_col, html_col), urls).withColumnRenamed("id", id_col)


def json_ld_postings(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """JobPosting objects of pages' JSON-LD blocks, at the top, in lists and in @graph."""
    found = markup.structured_postings(markup.elements(pages, id_col, html_col))
    return found.drop("identifier", "employment_type").withColumnRenamed("id", id_col)
