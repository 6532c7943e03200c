from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import explaining

SKILLS = "array<struct<name: string, status: string, importance: string, note: string, requirement_ids: array<string>, weight: double>>"
MUST = "array<struct<kind: string, status: string, score: double>>"


def skill(name, status, importance="required", ids=("R1",), weight=1.0):
    return (name, status, importance, "by Kafka", None if ids is None else list(ids), weight)


def found(spark, skills, must, fit=50.0, seniority="MATCH", location="MATCH", target=False, title=None):
    df = spark.createDataFrame([(skills, must, fit, seniority, location, target, title)], f"skills {SKILLS}, must {MUST}, fit double, seniority string, location string, target boolean, title string")
    return df.select(explaining.findings(*(F.col(c) for c in ("skills", "must", "fit", "seniority", "location", "target", "title"))).alias("f")).first().f


def test_findings_in_order(spark):
    skills = [skill("a", "GAP"), skill("b", "GAP", ids=("D1",)), skill("c", "GAP", "preferred"), skill("d", "GAP", "alternative"), skill("e", "TRANSFERABLE"), skill("f", "TRANSFERABLE", "preferred"), skill("g", "TRANSFERABLE"), skill("h", "PROJECT"), skill("i", "PROJECT", "preferred"), skill("j", "HISTORICAL", "preferred"), skill("k", "GAP", ids=None)]
    must = [("required", "MET", 1.0), ("required", "GAP", 0.0), ("required", "PARTIAL", 0.5), ("required", "UNKNOWN", None), ("preferred", "MET", 1.0)]
    got = found(spark, skills, must, 80.0, "UNDERQUALIFIED", "MISMATCH", True, "Data Engineer")
    assert [(f.rule, f.names) for f in got] == [
        ("met", []), ("required gaps", ["a"]), ("duty gaps", ["b", "k"]), ("alternatives", ["d"]), ("focus", []), ("transferable", ["e"]), ("transferable", ["f"]), ("projects only", ["h"]), ("not recent", ["j"]), ("seniority", ["UNDERQUALIFIED"]), ("location", ["MISMATCH"]), ("strong all the same", []),
    ]
    assert got[0].text.startswith("2 of 3 ") and got[4].text.endswith("as Data Engineer") and got[5].text == "e: by Kafka"


def test_findings_of_little(spark):
    assert found(spark, None, None, None, None, None, None) == []
    only = found(spark, [skill(f"p{i}", "GAP", "preferred") for i in range(7)], [], 69.9)
    assert [(f.rule, f.names) for f in only] == [("preferred gaps only", [f"p{i}" for i in range(5)])]
    assert [f.rule for f in found(spark, [skill("x", "STRONG")], [("required", "GAP", 0.0)], 99.0, target=True)] == ["met", "focus"]


def plan(spark, skills, boosts, own, seniority="MATCH", location="MATCH"):
    df = spark.createDataFrame([(skills, boosts, own, seniority, location)], f"skills {SKILLS}, boosts map<string, double>, own array<struct<name: string, level: string, production: boolean>>, seniority string, location string")
    s = df.select(explaining.strategy(*(F.col(c) for c in ("skills", "boosts", "own", "seniority", "location"))).alias("s")).first().s
    return [(e.term, e.why) for e in s.emphasise], s.play_down, [(c.rule, c.names) for c in s.concerns]


def test_strategy(spark):
    strong = [skill(f"s{i}", "STRONG" if i % 2 else "MODERATE", weight=float(i % 4)) for i in range(8)]
    own = [("b1", "STRONG", False), ("b2", "PROJECT", True), ("b3", "LISTED", False), ("b4", "MODERATE", None), ("s3", "STRONG", True), ("old", "LISTED", None)]
    emphasise, down, concerns = plan(spark, strong, {"b1": 0.3, "b2": 0.6, "b3": 0.6, "b4": 0.3, "s3": 0.9}, own)
    assert emphasise == [*((f"s{i}", "required") for i in (3, 7, 2, 6, 1, 5)), ("b2", "valued"), ("b1", "valued")]
    assert down == ["b2", "b3", "old"] and concerns == []
    worries = [skill("a", "GAP"), skill("b", "GAP", "preferred"), skill("c", "TRANSFERABLE", "alternative"), skill("d", "HISTORICAL", "preferred"), skill("e", "PROJECT"), skill("f", "PROJECT", "preferred"), skill("g", "LISTED"), skill("h", "STRONG")]
    _, _, concerns = plan(spark, worries, None, None, "STRETCH", "UNKNOWN")
    assert concerns == [("missing", ["a"]), ("transferable", ["c"]), ("not recent", ["d"]), ("projects only", ["e"]), ("listed only", ["g"]), ("seniority", ["STRETCH"]), ("location", ["UNKNOWN"])]
    assert len(plan(spark, [skill(str(i), "GAP") for i in range(20)], None, None, "STRETCH")[2]) == 8
    assert plan(spark, None, None, None, None, None) == ([], [], [])
