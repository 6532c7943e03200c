from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import listing, tailoring, claims, matching


def test_skill_levels(spark):
    now = 2024 * 12 + 3
    rows = [("c", 1, "Spark", "experience", "A", now), ("c", 2, "Spark", "role", "B", now - 40), ("c", 3, "Kafka", "tech_stack", "A", now - 50), ("c", 4, "Flink", "role", "A", None), ("c", 5, "dbt", "project", None, None), ("c", 6, "SQL", "skill_group", None, None)]
    df = spark.createDataFrame(rows, "candidate string, fact_id int, term string, category string, employer string, end_month int")
    out = {r.term: (r.level, r.score) for r in matching.skill_evidence(df, now).collect()}
    assert out == {"Spark": ("STRONG", 5.5), "Kafka": ("RUSTY", 2.0), "Flink": ("MODERATE", 2.0), "dbt": ("PROJECT", 0.5), "SQL": ("LISTED", 0.5)}


def test_terms_transfer_within_a_family(spark):
    skills = spark.createDataFrame([("c", "Kafka", "STRONG"), ("c", "Pulsar", "STRONG"), ("c", "SQL", "LISTED")], "candidate string, term string, level string")
    families = spark.createDataFrame([("Kafka", "queue", 0.6), ("Pulsar", "queue", 0.6), ("Kinesis", "queue", 0.6), ("Rust", "lang", 0.5)], "term string, family string, transfer double")
    wanted = spark.createDataFrame([("c", "j", "R1", t, m) for t, m in (("Kinesis", "all"), ("SQL", "all"), ("Rust", "all"))] + [("c", "j", "R2", t, "any") for t in ("Kafka", "Rust")], "candidate string, job string, req string, term string, mode string")
    terms = matching.assess_terms(wanted, skills, families)
    assert {(r.req, r.term): (r.score, r.status, r.via) for r in terms.collect()} == {("R1", "Kinesis"): (0.6, "TRANSFERABLE", "Kafka"), ("R1", "SQL"): (0.4, "LISTED", None), ("R1", "Rust"): (0.0, "GAP", None), ("R2", "Kafka"): (1.0, "STRONG", None), ("R2", "Rust"): (0.0, "GAP", None)}
    scores = {r.req: round(r.score, 4) for r in matching.requirement_scores(terms, ["job", "req"]).collect()}
    assert scores == {"R1": round(1 / 3, 4), "R2": 1.0}
    fit = matching.skills_fit(terms.withColumn("w", F.when(F.col("req") == "R2", 1.0).otherwise(0.0)), ["job"], "w").first()
    assert fit.skills_fit == 50.0


def test_fits(spark):
    jobs = spark.createDataFrame([(1, "Pune; Berlin"), (2, "Remote"), (3, "Remote, US"), (4, "Goa, India"), (5, "Paris"), (6, None), (7, "Unknown")], "id int, place string")
    out = {r.id: (r.status, r.score) for r in matching.location_fit(jobs, "id", "place", ["Pune"], True, "India", True, False).collect()}
    assert out == {1: ("MATCH", 100.0), 2: ("MATCH", 95.0), 3: ("MISMATCH", 10.0), 4: ("MATCH", 85.0), 5: ("MISMATCH", 0.0), 6: ("UNKNOWN", 60.0), 7: ("UNKNOWN", 60.0)}
    pay = spark.createDataFrame([(100.0, "USD"), (90.0, "USD"), (50.0, "USD"), (100.0, "EUR"), (None, None)], "top double, cur string")
    fit = matching.compensation_fit(F.col("top"), F.col("cur"), 100.0, "usd")
    assert [r.x.status for r in pay.select(fit.alias("x")).collect()] == ["MATCH", "CLOSE", "BELOW", "UNKNOWN", "UNKNOWN"]
    rows = [(3.0, 5.0, None, None, None, "UNDERQUALIFIED"), (4.0, 5.0, 8.0, 2, 4, "UNDERQUALIFIED"), (4.0, 5.0, None, 3, 3, "STRETCH"), (20.0, 2.0, 4.0, 3, 3, "OVERQUALIFIED"), (6.0, 5.0, 8.0, 3, 3, "STRONG_MATCH"), (None, None, None, None, None, "UNKNOWN"), (None, None, None, 5, 3, "OVERQUALIFIED")]
    df = spark.createDataFrame(rows, "y double, lo double, hi double, lv int, jl int, want string")
    assert all(r.x.status == r.want for r in df.select("want", matching.seniority_fit(*(F.col(c) for c in ("y", "lo", "hi", "lv", "jl"))).alias("x")).collect())


def test_claims_need_their_facts(spark):
    facts = spark.createDataFrame([(1, "Built Spark pipelines that cut cost 40% for 3 teams.", ["Spark"], True), (2, "Wrote SQL reports.", ["SQL"], False)], "fact_id int, statement string, terms array<string>, production boolean")
    job = "You will design and run streaming data platforms at very large scale every day."
    rows = [
        (1, "Cut cost 40% with Spark pipelines.", ["Spark"], [1], []),
        (2, "Cut cost 55% with Kafka.", ["Kafka"], [1], ["terms", "numbers"]),
        (3, "Led SQL reports in production as a senior engineer.", ["SQL"], [2], ["leadership", "production", "seniority"]),
        (4, "I design and run streaming data platforms at very large scale.", [], [1], ["copied"]),
        (5, "Anything.", [], [], ["no source", "length"]),
    ]
    df = spark.createDataFrame([(i, t, terms, f, "Engineer", job, want) for i, t, terms, f, want in rows], "claim_id int, text string, terms array<string>, fact_ids array<int>, titles string, job_text string, want array<string>")
    out = claims.verify(df, facts, F.lit(False)).collect()
    assert len(out) == 5
    for r in out:
        assert r.notes == r.want and r.ok == (not r.want)


def test_coverage_and_stuffing(spark):
    need = spark.createDataFrame([("v", "R1", True), ("v", "R2", True), ("v", "R3", False), ("w", "R1", False)], "variant string, requirement_id string, attainable boolean")
    made = spark.createDataFrame([("v", ["R1", "R3"]), ("v", ["R1"])], "variant string, requirement_ids array<string>")
    assert {r.variant: r.coverage for r in claims.coverage(made, need, "variant").collect()} == {"v": 50.0, "w": 70.0}
    df = spark.createDataFrame([("spark " * 8, ""), ("spark " * 8, "spark " * 7), ("spark", "")], "t string, b string")
    assert [r.x for r in df.select(claims.stuffed(F.col("t"), F.lit("Spark"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_names_of_many_words_match_boards(spark):
    words = "one two three four five six seven eight nine"
    boards = spark.createDataFrame([(1, "", f"jobs at {words} inc"), (2, "acmelabs", ""), (3, "", "one two"), (4, None, None)], "board_id long, key string, title string")
    companies = spark.createDataFrame([("a", "x", words), ("b", "acme", "acme"), ("c", "ac", "zz"), ("d", "", "one two"), ("e", "y", "two  three")], "company_id string, name_key string, name string")
    assert {tuple(r) for r in listing.board_matches(boards, companies).collect()} == {(1, "a"), (2, "b"), (1, "e")}
    assert listing.board_matches(boards, companies.limit(0)).collect() == []


def test_prefixes_form_no_other_pairs(spark):
    names = ["data", "data group", "data group labs", "the bank", "the", "ab", "ab c", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = {tuple(r) for r in listing.word_prefixes(df, "i", "n", df.withColumnsRenamed({"i": "j", "n": "m"}), "j", "m").collect()}
    long = lambda s: s and len(s.replace(" ", "")) >= 3
    begins = lambda a, b: b.split()[: len(a.split())] == a.split()
    assert got == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if long(a) and long(b) and (begins(a, b) or begins(b, a))}


def test_policies_of_a_tier_hold_as_one(spark):
    rows = spark.createDataFrame([(1, "S", 60.0, 3), (2, "X", 60.0, 1)], "k int, tier string, fit double, ordinal int")
    policies = spark.createDataFrame([("S", "off", 10.0, 1), ("S", "auto", 50.0, 4), ("S", "auto", 90.0, 9)], "tier string, mode string, least_fit double, worst_class int")
    assert {r.k: r.decision for r in tailoring.apply_policy(rows, policies, "ordinal").collect()} == {1: "auto", 2: "manual"}
