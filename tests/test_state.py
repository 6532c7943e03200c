from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomline.functions import jobs
from fathomline.operators import listing, postings, requirements, state, tailoring, terms


def test_nulls_never_overwrite_and_nothing_is_lost(spark):
    old = spark.createDataFrame([(1, "a", "x", "remote", None), (2, None, "y", "unknown", None)], "id int, title string, salary string, remote_status string, posted_at timestamp")
    new = spark.createDataFrame([(1, None, "z", "unknown", None), (9, "q", "q", "onsite", None)], "id int, title string, salary string, remote_status string, posted_at timestamp")
    rows = {r.id: r for r in state.refresh(old, new, "id").collect()}
    assert (rows[1].title, rows[1].salary, rows[1].remote_status, rows[1].changed) == ("a", "z", "remote", True)
    assert not rows[2].changed and not rows[2].seen and len(rows) == 2
    sources = spark.createDataFrame([("s", "1", "J", None, "title", "OPEN")], "source string, external_id string, job_id string, application_url string, title string, status string")
    seen = spark.createDataFrame([("s", "1", "J", "u", None, "updated")], "source string, external_id string, job_id string, application_url string, title string, outcome string")
    r = postings.apply_ingest(sources, seen).first()
    assert (r.title, r.application_url, r.status) == ("title", "u", "OPEN")


def test_reviews_of_seeds_settle_one_event(spark):
    events = spark.createDataFrame([(1, 1, "PENDING"), (2, 1, "PENDING"), (3, 2, "PENDING"), (4, 2, "PENDING"), (5, 2, "ACCEPTED")], "event_id int, company_id int, status string")
    companies = spark.createDataFrame([(1, True), (2, False)], "company_id int, is_seed boolean")
    reviews = spark.createDataFrame([(1, "ignore"), (3, "ignore")], "event_id int, action string")
    got = {r.event_id: r.status for r in state.review_events(events, reviews, companies).collect()}
    assert got == {1: "IGNORED", 2: "PENDING", 3: "IGNORED", 4: "IGNORED", 5: "ACCEPTED"}


def test_an_employers_name_goes_only_as_a_whole_word(spark):
    rows = [("Software Engineer", "spark kafka airflow sparkling", "Spark"), ("Software Engineer", "c++ (labs) spark", "C++ (Labs)"), ("Software Engineer", None, None)]
    out = spark.createDataFrame(rows, "t string, d string, c string").select(jobs.classify_role(F.col("t"), F.col("d"), F.col("c"))["category"].alias("k")).collect()
    assert len(out) == 3 and all(r.k for r in out)


def test_terms_and_requirements_of_odd_texts(spark):
    patterns = {"SQL": terms.EDGES[0] + "sql" + terms.EDGES[1]}
    rows = [(1, "MySQL and NoSQL"), (2, "plain SQL, sql"), (3, None), (4, ""), (5, "SQL Server")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.t for r in df.select("id", terms.term_names(terms.find_terms(F.col("text"), patterns)).alias("t")).collect()}
    assert got == {1: [], 2: ["SQL"], 3: [], 4: [], 5: []}
    every = requirements.analyze_postings(df.withColumn("title", F.lit(None).cast("string")), "id", "title", "text", patterns).collect()
    assert len(every) == 5 and {r.id: r.n_requirements for r in every}[3] == 0


def test_split_keeps_brackets_together(spark):
    rows = [("a, b (c, d), [e, {f, g}], h",), ("",), (None,), (")x, y",)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(tailoring.split_top_level(F.col("t")).alias("p")).collect()]
    assert got == [["a", "b (c, d)", "[e, {f, g}]", "h"], [], [], [")x", "y"]]


def test_settings_and_weights():
    assert listing.merged_settings({"a": {"x": 1.0, "y": 2.0}, "b": 1}, {"a": {"x": 3, "z": 4}, "b": "no", "c": 5}) == {"a": {"x": 3, "y": 2.0}, "b": 1}
    for check, bad in ((listing.check_descending, {"P0": 1.0, "P1": 1.0}), (lambda w: listing.check_weights(w, ["a"]), {"a": -1.0}), (lambda w: listing.check_weights(w, ["a"]), {"b": 1.0})):
        with pytest.raises(ValueError):
            check(bad)
