from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fathomline.operators import companies, workflow
from fathomline.sources import feeds

NOW = "2024-03-05 12:00:00"


def test_names_and_domains(spark):
    rows = [("Acme Technologies Pvt. Ltd.", "acme.com", "acmetechnologies", 0.7), ("Flipkart", "flipkartcareers.com", "flipkart", 0.8), ("Amazon (AWS)", "amazon.jobs", "amazon", 1.0), ("Société & Co", "other.com", "societe", 0.0), ("Data.io", "data.io", "data", 1.0), ("Inc", "x.com", "inc", 0.0)]
    df = spark.createDataFrame(rows, "name string, domain string, key string, want double")
    out = df.select("key", "want", companies.name_key(F.col("name")).alias("k"), companies.domain_evidence(F.col("name"), F.col("domain")).alias("s")).collect()
    assert [(r.k, r.s) for r in out] == [(r.key, r.want) for r in out]


def test_frontier_lifecycle_and_target(spark):
    df = spark.createDataFrame([(1, 4, 1, 2, True, None, 10.0, True), (0, 0, 0, 0, None, True, None, False)], "data_roles int, hiring_signals int, hiring_posts int, hiring_sources int, india_presence boolean, product_company boolean, signal_age_hours double, is_seed boolean")
    assert [r.priority for r in companies.frontier_points(df).collect()] == [35 + 30 + 20 + 15 + 15 + 25, 10.0]
    rows = [(True, 3, True, True, "INACTIVE"), (False, 1, True, False, "ACTIVE"), (False, 0, True, True, "INACTIVE"), (False, 0, True, False, "VERIFIED"), (False, 2, False, False, "UNVERIFIED")]
    df = spark.createDataFrame(rows, "i boolean, n int, s boolean, c boolean, want string")
    assert all(r.x == r.want for r in df.select("want", companies.lifecycle(*(F.col(c) for c in "insc")).alias("x")).collect())
    columns = "open_roles int, fresh_roles int, best_fit double, discovery map<string,double>, tier string, kind string, pay_known boolean, pay_match boolean, places int, places_ok int, india boolean, remote boolean, terms int, terms_known int, own boolean"
    rows = [(3, 2, 80.0, {"engineering_quality": 70.0}, "S", "SaaS", True, True, 2, 1, None, None, 4, 3, False), (0, 0, None, {}, None, None, False, None, 0, 0, None, None, 0, 0, False), (5, 5, 100.0, {}, "S", "product", True, True, 1, 1, True, True, 1, 1, True)]
    out = [r.target_score for r in companies.target_score(spark.createDataFrame(rows, columns), F.col("own")).collect()]
    first = 0.2 * 90 + 0.15 * 80 + 0.1 * 70 + 0.1 * 80 + 0.1 * 75 + 0.05 * 85 + 0.15 * 50 + 0.15 * 75
    assert out == [round(first, 1) if first * 10 % 1 != 0.5 else out[0], 40.0, 35.0]


def test_transitions(spark):
    apps = spark.createDataFrame([("a", "USER_REVIEW"), ("b", "APPROVED"), ("c", "USER_REVIEW"), ("d", "USER_REVIEW")], "application_id string, status string")
    events = spark.createDataFrame([("a", 1, None, "APPROVED"), ("a", 2, "APPROVED", "USER_REVIEW"), ("c", 1, "USER_REVIEW", "APPROVED")], "application_id string, created_at int, from_status string, to_status string")
    asked = spark.createDataFrame([("a", "APPLIED"), ("b", "APPLIED"), ("c", "READY_TO_APPLY"), ("d", "APPROVED"), ("d", "NOPE"), ("z", "APPLIED")], "application_id string, to_status string")
    out = {(r.application_id, r.to_status): r.problem for r in workflow.check_transitions(asked, apps, events).collect()}
    assert out == {("a", "APPLIED"): "not approved", ("b", "APPLIED"): None, ("c", "READY_TO_APPLY"): None, ("d", "APPROVED"): None, ("d", "NOPE"): "unknown status", ("z", "APPLIED"): "unknown application"}


def test_recommendations_follow_classes(spark):
    jobs = spark.createDataFrame([(i, c) for i, c in enumerate(["P0", "P1", "P1", "REJECT", "REJECT", "REJECT"])], "job_id int, priority_class string")
    apps = spark.createDataFrame([(1, "WITHDRAWN"), (2, "WITHDRAWN"), (3, "RECOMMENDED"), (4, "APPLIED")], "job_id int, status string")
    last = spark.createDataFrame([(1, "system"), (2, "user")], "job_id int, actor string")
    out = {r.job_id: r.to_status for r in workflow.sync_recommendations(jobs, apps, last).collect()}
    assert out == {0: "RECOMMENDED", 1: "RECOMMENDED", 3: "WITHDRAWN"}


def test_leases_and_budgets(spark):
    t = lambda h: dt.datetime(2024, 3, 5, h)
    runs = spark.createDataFrame([(1, "RUNNING", 1, 3, "w", t(11)), (2, "RUNNING", 3, 3, "w", t(11)), (3, "RUNNING", 1, 3, "w", t(13)), (4, "DONE", 1, 3, None, None)], "id int, status string, attempts int, max_attempts int, lease_owner string, lease_expires_at timestamp")
    out = workflow.recover_leases(runs, F.lit(NOW).cast("timestamp")).orderBy("id").collect()
    assert [r.status for r in out] == ["QUEUED", "FAILED", "RUNNING", "DONE"] and out[0].lease_owner is None and out[2].lease_owner == "w"
    split = spark.range(1).select(workflow.query_split(F.lit(8)).alias("s")).first().s
    assert sum(split) == 8 and split.reserve == 2


def test_feeds(spark):
    stories = spark.createDataFrame([("1", "Ask HN: Who is hiring? (Feb)", dt.datetime(2024, 2, 1)), ("2", "Ask HN: Who is hiring? (Mar)", dt.datetime(2024, 3, 1)), ("3", "Show HN", dt.datetime(2024, 3, 4))], "id string, title string, created_at timestamp")
    now = F.lit(NOW).cast("timestamp")
    thread = feeds.hiring_threads(stories, now)
    assert thread.first().id == "2"
    comments = spark.createDataFrame([("a", "2", "Acme Inc | Remote | Senior Data Engineer<p>More"), ("a", "2", "Acme Inc | Remote | Senior Data Engineer<p>More"), ("b", "9", "X | Data Engineer"), ("c", "2", "Y | Chef")], "object_id string, parent_id string, html string").withColumn("created_at", now)
    row, = feeds.hiring_posts(comments, thread).collect()
    assert (row.company, row.company_key, row.role_title, row.remote) == ("Acme Inc", "acme", "Senior Data Engineer", "remote")
    rows = spark.createDataFrame([("Acme", "Active", True, ["India"], ["B2B"], [], "data tools", 60), ("Tiny", "Active", True, ["India"], ["B2B"], [], "", 5), ("Known", None, True, ["India"], ["B2B"], [], "", 50), ("Off", "Inactive", True, ["India"], ["B2B"], [], "", 50)], "name string, status string, is_hiring boolean, regions array<string>, industries array<string>, tags array<string>, one_liner string, team_size int")
    known = spark.createDataFrame([("known",)], "company_key string")
    assert [(r.name, r.score) for r in feeds.startups(rows, known, ["India"], 5).collect()] == [("Acme", 8)]


def test_search_results(spark):
    t = lambda h: dt.datetime(2024, 3, 5, h)
    rows = [("q", "p1", "http://a/?utm_x=1", 1, t(9)), ("q", "p1", "http://a/", 2, t(9)), ("q", "p2", "http://b/", 1, t(11)), ("r", "p2", "http://c/", 1, t(2))]
    df = spark.createDataFrame(rows, "query string, provider string, url string, rank int, fetched_at timestamp")
    assert [r.url for r in feeds.cached_results(df, F.lit(NOW).cast("timestamp")).collect()] == ["http://b/"]
    out = {(r.query, r.url, r.rank) for r in feeds.first_provider(df, ["p1", "p2"], []).collect()}
    assert out == {("q", "http://a/", 1), ("r", "http://c/", 1)}
    assert {r.url for r in feeds.first_provider(df, ["p1", "p2"], ["p1"]).collect()} == {"http://b/", "http://c/"}
