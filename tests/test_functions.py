from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomline.functions import dates, jobs, scores, text

NOW = "2026-10-07 12:00:00"


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("posted", "precision", "status"),
    [
        ("2026-10-07 02:00:00", "datetime", "fresh"),
        ("2026-10-05 12:30:00", "datetime", "fresh"),
        ("2026-10-05 10:00:00", "datetime", "recent"),
        ("2026-09-29 04:00:00", "datetime", "stale"),
        ("2026-10-07 00:00:00", "date", "fresh"),
        ("2026-10-05 00:00:00", "date", "recent"),
        ("2026-10-06 00:00:00", "local_datetime", "recent"),
        (None, None, "unknown"),
    ],
)
def test_freshness_uses_the_greatest_age(spark, posted, precision, status):
    bounds = dates.age_bounds(F.col("p").cast("timestamp"), F.col("k"), F.lit(NOW).cast("timestamp"))
    assert one(spark, dates.freshness_status(bounds[1]), p=posted, k=precision) == status
    low, high = (one(spark, b, p=posted, k=precision) for b in bounds)
    assert low is high is None if posted is None else 0 <= low <= high


@pytest.mark.parametrize(
    ("value", "when", "precision"),
    [
        ("2024-03-05", dt.datetime(2024, 3, 5), "date"),
        ("2024-03-05T10:20:30Z", dt.datetime(2024, 3, 5, 10, 20, 30), "datetime"),
        ("2024-03-05T10:20:30+02:00", dt.datetime(2024, 3, 5, 8, 20, 30), "datetime"),
        ("2024-03-05 10:20:30", dt.datetime(2024, 3, 5, 10, 20, 30), "local_datetime"),
        ("1709634030", dt.datetime(2024, 3, 5, 10, 20, 30), "datetime"),
        ("1709634030000", dt.datetime(2024, 3, 5, 10, 20, 30), "datetime"),
        ("March 5, 2024", dt.datetime(2024, 3, 5), "date"),
        ("5 Mar 2024", dt.datetime(2024, 3, 5), "date"),
        ("soon", None, None),
        ("2024-13-45", None, None),
        (None, None, None),
    ],
)
def test_parse_posted(spark, value, when, precision):
    got = one(spark, dates.parse_posted(F.col("v")), v=value)
    assert (got.value, got.precision) == (when, precision)


def test_small_date_functions(spark):
    days = lambda v: one(spark, dates.days_ago(F.col("v"), F.lit("2024-03-05").cast("date")), v=v)
    assert [days(v) for v in ("Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "x")] == [dt.date(2024, 3, 5), dt.date(2024, 3, 4), dt.date(2024, 3, 2), None, None]
    month = lambda v: one(spark, dates.month_index(F.col("v"), F.lit("2024-03-05").cast("date")), v=v)
    assert [month(v) for v in ("2024-01", "present", "?")] == [24289, 24291, None]
    assert one(spark, dates.freshness_decay(F.col("a")), a=12.0) == 75.0
    assert one(spark, dates.freshness_decay(F.col("a").cast("double")), a=None) == 0.0
    assert one(spark, dates.retry_delay(F.col("n")), n=10) == 900
    assert one(spark, dates.employee_range(F.col("n")), n=0) is None


def test_text(spark):
    assert one(spark, text.normalize_title(F.col("t")), t="Sr. SDE - Big Data!") == "senior software engineer data"
    assert one(spark, text.posting_key(F.lit("ACME"), F.col("t")), t="Data Engineer-12") == ("acme", "data engineer")
    page = "<html><title>A &amp; B</title><script>x()</script><h1>Hi <b>there</b></h1><p>One<br>two&nbsp;three</p></html>"
    assert one(spark, text.html_to_text(F.col("h")), h=page) == "A & B\nHi there\nOne\ntwo\u00a0three"
    assert one(spark, text.page_title(F.col("h")), h=page) == "A & B"
    assert one(spark, text.first_heading(F.col("h")), h=page) == "Hi there"
    assert one(spark, text.metrics(F.col("t")), t="Cut cost 42% in 2021 with 4TB+ a day, 80ms, 42%") == ["42%", "4TB+", "80ms"]
    assert one(spark, text.bounded_id(F.col("t")), t="x" * 300).startswith("x" * 159 + "-")


@pytest.mark.parametrize(
    ("url", "canonical", "domain"),
    [
        ("HTTPS://User@Jobs.Example.co.uk:443/A?utm_x=1&b=2&&ref=q#f", "https://user@jobs.example.co.uk:443/A?b=2", "example.co.uk"),
        ("http://a.b.example.com", "http://a.b.example.com", "example.com"),
        ("/only/path?gclid=1", "/only/path", None),
        ("http://localhost/x", "http://localhost/x", None),
    ],
)
def test_urls(spark, url, canonical, domain):
    assert one(spark, text.canonical_url(F.col("u")), u=url) == canonical
    assert one(spark, text.registrable_domain(text.host_name(F.col("u"))), u=url) == domain


@pytest.mark.parametrize(
    ("title", "body", "category", "target"),
    [
        ("Senior Data Engineer", "", "data_engineering", True),
        ("Staff Engineer, Data Platform", "", "data_engineering", True),
        ("Platform Engineer", "", "platform_infrastructure", True),
        ("Site Reliability Engineer", "", "platform_infrastructure", False),
        ("Data Analyst", "dashboards", "adjacent_data", False),
        ("Analytics Engineer", "", "adjacent_data", False),
        ("Sales Engineer", "", "non_target", False),
        ("Data Center Technician", "", "non_target", False),
        ("Software Engineer", "PySpark, Kafka, Airflow and data pipelines", "data_engineering", True),
        ("Software Engineer", "React", "other_engineering", False),
        ("Network Infrastructure Engineer", "", "other_engineering", False),
        ("Chef", "", "non_target", False),
        ("", "", "unclassified", False),
    ],
)
def test_roles(spark, title, body, category, target):
    role = one(spark, jobs.classify_role(F.col("t"), F.col("b"), F.lit("Acme")), t=title, b=body)
    assert role.category == category
    assert one(spark, jobs.is_target(F.col("c"), F.col("r")), c=role.category, r=float(role.relevance)) == target


def test_an_employers_name_is_no_signal(spark):
    body = "Snowflake builds Spark, Kafka and data pipelines."
    count = lambda c: len(one(spark, jobs.classify_role(F.lit("Engineer"), F.col("b"), F.lit(c)), b=body).signals)
    assert count("Acme") == count("Snowflake") + 1


def test_requirements(spark):
    assert one(spark, jobs.years_required(F.col("t")), t="5-8 years of experience") == (5.0, 8.0)
    assert one(spark, jobs.years_required(F.col("t")), t="3+ yrs Spark") == (3.0, None)
    assert one(spark, jobs.years_required(F.col("t")), t="founded 99 years ago") == (None, None)
    assert one(spark, jobs.compensation(F.col("t")), t="Pay: $120k - $150k") == (120000.0, 150000.0, "USD", "year")
    assert one(spark, jobs.compensation(F.col("t")), t="INR 20 - 35 LPA") == (2000000.0, 3500000.0, "INR", "year")
    assert one(spark, jobs.compensation(F.col("t")), t="$90 - $50 /hr") == (None,) * 4
    assert [one(spark, jobs.seniority(F.col("t"), F.col("y").cast("double")), t=t, y=y) for t, y in (("Sr Engineer", 1), ("Engineer", 6), ("Engineer", None))] == ["senior", "senior", "unknown"]
    assert [one(spark, jobs.remote_status(F.col("t")), t=t) for t in ("Remote or hybrid", "hybrid", "On-site", "Berlin")] == ["remote", "hybrid", "onsite", "unknown"]
    assert one(spark, jobs.technologies(text.normalize_text(F.col("t"))), t="PySpark, Kafka & k8s") == ["Apache Spark", "Apache Kafka", "Kubernetes"]


@pytest.mark.parametrize(
    ("url", "platform", "key"),
    [
        ("https://boards.greenhouse.io/acme/jobs/1", "greenhouse", "acme"),
        ("https://boards.greenhouse.io/embed/job_board?for=acme", "greenhouse", "acme"),
        ("https://jobs.eu.lever.co/acme/123", "lever", "acme"),
        ("https://jobs.ashbyhq.com/acme", "ashby", "acme"),
        ("https://acme.wd5.myworkdayjobs.com/en-US/External/job/1", "workday", "External"),
        ("https://acme.recruitee.com/o/x", "recruitee", "acme"),
        ("https://acme.com/careers", None, None),
    ],
)
def test_platforms(spark, url, platform, key):
    assert one(spark, jobs.platform_of(F.col("u")), u=url) == (platform, key)


def test_priority_gates_floors_and_caps(spark):
    rows = [(90.0, 80.0, False, None, 0), (90.0, 70.0, False, None, 1), (90.0, 90.0, True, None, 4), (90.0, 90.0, False, "P3", 3), (50.0, 90.0, False, "P2", 3), (30.0, 90.0, False, "P2", 4), (81.0, 50.0, False, None, 3)]
    df = spark.createDataFrame(rows, "score double, fit double, gated boolean, cap string, want int")
    caps = [("P2", F.col("cap") == "P2"), ("P3", F.col("cap") == "P3")]
    out = df.select("want", scores.priority_ordinal(F.col("score"), F.col("fit"), F.col("gated"), caps).alias("got")).collect()
    assert all(r.got == r.want for r in out)


def test_scores(spark):
    assert one(spark, scores.weighted_mean({"a": F.col("v"), "b": F.lit(0.0)}, {"a": 1, "b": 3}), v=80.0) == 20.0
    assert one(spark, scores.percent(F.col("a"), F.col("b")), a=1, b=3) == 33.3 and one(spark, scores.percent(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, scores.engineering_quality(F.col("a"), F.col("a"), F.col("a")), a=0) == 50


def test_html_entities_and_long_pages(spark, tmp_path):
    import hashlib
    import html

    from fathomline.plans import catalog

    coded = "Caf&eacute; &uuml;ber &#8217;x&#x2019; &hearts; &copy2 &amp;lt; &nosuch; A&B"
    assert one(spark, text.unescape(F.col("h")), h=coded) == html.unescape(coded)
    assert one(spark, text.page_title(F.col("h")), h=f"<title>{coded}</title>") == html.unescape(coded)
    assert one(spark, text.html_to_text(F.col("h")), h=None) == "" and one(spark, text.unescape(F.col("h")), h=None) is None
    pages = [(1, "http://a.com/", "<p>" + "word " * 50_000 + "&eacute;</p>"), (2, "http://a.com/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n_chars, r.sha256) for r in catalog.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    whole = "word " * 50_000 + "é"
    assert got == {1: (250_001, hashlib.sha256(whole.encode()).hexdigest()), 2: (0, hashlib.sha256(b"").hexdigest())}


def test_breakdown_counts_all_words(spark, tmp_path):
    from fathomline.plans import catalog

    spark.createDataFrame([(1, "a b c d e f g", 2), (2, "g a", 3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.word: (r.parts, r.sizes) for r in catalog.QUERIES["multi_value_breakdown"](spark, str(tmp_path)).collect()}
    assert got == {**{w: (1, 2) for w in "bcdef"}, "a": (2, 5), "g": (2, 5)}


def test_target_titles_are_those_of_the_whole_classification(spark):
    titles = [
        "Data Engineer", "Senior Data Engineer, Data Analyst", "Data Analyst, Data Engineer", "Data Analyst | data pipelines", "Master Data Engineer", "SAP Data Platform", "Data Center Data Engineer", "Sales Data Engineer", "Platform Engineer", "Platform Engineer - Firmware",
        "Salesforce Platform Engineer", "DevOps", "Cloud Engineer", "Site Reliability", "Database Engineer (ML Engineer)", "Electrical Platform Engineer", "Software Engineer", "Java Developer", "SWE kafka spark airflow dbt", "Data Engineer kafka", "Analytics Engineer", "Nurse", "  ", "", None,
        "Kernel data pipeline", "Backend Engineer on data", "Software Engineer, Platform", "Distributed Systems \u2013 Data Scientist", "Data Engineer (Product Analyst)",
    ]
    far = "word " * 4000
    bodies = [None, "", "Spark", "kafka spark airflow", far + "kafka spark airflow dbt", far + "kubernetes terraform microservices", far + "tableau looker excel", far + "pcb asic", "tableau looker excel", far + "acme pcb asic Spark"]
    rows = spark.createDataFrame([(t, b, c) for t in titles for b in bodies for c in (None, "Spark")], "t string, b string, c string")
    role = jobs.classify_role(F.col("t"), F.col("b"), F.col("c"))
    got = rows.select("t", "b", "c", jobs.names_target(F.col("t"), F.col("b"), F.col("c")).alias("got"), jobs.is_target(role["category"], role["relevance"]).alias("want"), (F.char_length("b") > 8000).alias("far")).collect()
    assert [r for r in got if r.got is not r.want] == []
    assert {(r.far, r.got) for r in got if r.t in ("Software Engineer", "Cloud Engineer")} >= {(True, True), (True, False), (False, False)}
