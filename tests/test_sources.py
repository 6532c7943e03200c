from __future__ import annotations

import json

from fathomline.sources import boards


def landing(spark, payload, company="Acme"):
    return spark.createDataFrame([(company, json.dumps(payload))], "company string, payload string")


def test_greenhouse(spark):
    job = {"id": 7, "title": "Data Engineer", "absolute_url": "https://x/7", "location": {"name": "Remote, India"}, "first_published": "2024-03-05T10:00:00-05:00", "updated_at": "2024-04-01T00:00:00Z", "content": "&lt;p&gt;Build &amp;amp; run&lt;/p&gt;"}
    row = boards.greenhouse(landing(spark, {"jobs": [job]})).first()
    assert row.asDict()["external_id"] == "7" and row.remote_status == "remote" and row.description == "Build & run"
    assert str(row.posted_at) == "2024-03-05 15:00:00" and row.posted_at_precision == "datetime" and row.company == "Acme"
    assert boards.greenhouse(landing(spark, {"jobs": []})).count() == 0


def test_lever(spark):
    job = {"id": "q", "text": "Engineer", "hostedUrl": "https://h", "createdAt": 1709634030000, "workplaceType": "hybrid", "descriptionPlain": "Plain.", "lists": [{"text": "Must", "content": "<li>Spark</li>"}], "categories": {"location": "", "allLocations": ["Pune", "Goa"], "commitment": "Full"}, "salaryRange": {"currency": "INR", "min": 1, "max": 2, "interval": "year"}}
    row = boards.lever(landing(spark, [job])).first()
    assert (row.location, row.remote_status, row.salary, row.application_url) == ("Pune, Goa", "hybrid", "INR 1-2 year", "https://h")
    assert row.description == "Plain.\nMust\nSpark" and row.employment_type == "Full"


def test_ashby(spark):
    jobs = [{"id": "1", "title": "A", "jobUrl": "u", "location": "Pune", "secondaryLocations": [{"location": "Goa"}, {"location": "Pune"}], "isRemote": True, "descriptionHtml": "<b>x</b>", "publishedAt": "2024-03-05"}, {"id": "2", "title": "B", "jobUrl": "v", "isListed": False}]
    rows = boards.ashby(landing(spark, {"jobs": jobs})).collect()
    assert [(r.title, r.location, r.remote_status, r.posted_at_precision) for r in rows] == [("A", "Pune; Goa", "remote", "date")]


def test_recruitee(spark):
    offers = [{"id": 1, "title": "A", "careers_url": "u", "status": "published", "description": "<p>x</p>", "requirements": "y"}, {"id": 2, "title": "B", "careers_url": "v", "status": "draft"}, {"id": 3, "title": "C", "careers_url": "w"}]
    rows = boards.recruitee(landing(spark, {"offers": offers})).orderBy("title").collect()
    assert [r.title for r in rows] == ["A", "C"] and rows[0].description == "x\ny" and rows[1].location == "Unknown"


def test_workday_and_amazon(spark):
    listing = {"jobPostings": [{"title": "A", "externalPath": "/job/1", "postedOn": "Posted 2 Days Ago", "locationsText": "Pune"}] * 2}
    page = landing(spark, {"listing": listing, "host": "acme.wd1.myworkdayjobs.com", "site": "Ext", "fetched_on": "2024-03-05"})
    details = spark.createDataFrame([("/job/9", "{}")], "path string, payload string")
    rows = boards.workday(page, details).collect()
    assert len(rows) == 1 and rows[0].application_url == "https://acme.wd1.myworkdayjobs.com/Ext/job/1" and str(rows[0].posted_at) == "2024-03-03 00:00:00"
    jobs = json.dumps({"jobs": [{"id_icims": "5", "title": "A", "posted_date": "March 5, 2024", "description": "d", "job_path": "/en/5"}]})
    both = spark.createDataFrame([("Amazon", 1, jobs), ("Amazon", 0, jobs)], "company string, scope int, payload string")
    rows = boards.amazon(both).collect()
    assert [(r.external_id, r.posted_at_precision, r.source_url) for r in rows] == [("5", "date", "https://www.amazon.jobs/en/5")]


def test_scan_status(spark):
    rows = [(200, 0, True), (200, 2, True), (403, 0, True), (404, 0, True), (500, 0, True), (None, 0, True), (200, 0, False)]
    out = boards.scan_status(spark.createDataFrame(rows, "http_status int, errors int, enumerated boolean")).collect()
    assert [(r.status, r.complete) for r in out] == [("OK", True), ("PARTIAL", False), ("BLOCKED", False), ("NOT_FOUND", False), ("ERROR", False), ("ERROR", False), ("OK", False)]


def test_links_and_json_ld(spark):
    page = """<a href="/a?utm_x=1">A</a><a href='b'>B</a><a href="//other.com/c"><b>C</b></a><a href="mailto:x@y.z">m</a><a href="/a">again</a>
    <script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Data Engineer", "datePosted": "2024-03-05", "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Pune"}}], "description": "<p>Hi</p>",}]}</script>"""
    pages = spark.createDataFrame([(1, "https://x.com/d/e?q", page)], "page_id int, url string, html string")
    out = boards.links(pages, "page_id", "url", "html").orderBy("place").collect()
    assert [(r.link, r.label) for r in out] == [("https://x.com/a", "A"), ("https://x.com/d/b", "B"), ("https://other.com/c", "C")]
    job = boards.json_ld_postings(pages, "page_id", "html").first()
    assert (job.title, job.company, job.location, job.posted_at_precision, job.description) == ("Data Engineer", "Acme", "Pune", "date", "Hi")
