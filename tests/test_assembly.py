from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import assembly, matching, profiles
from fathomline.plans import matched
from fathomline.plans.registry import Tables

FACT = "k long, position int, category string, statement string, entry int, item int, label string, employer string"


def plain(facts, wanted):
    """Facts by one loop after another into a list of (kind, text)."""
    jobs, works, out = {}, {}, {"summary": [], "skills": [], "education": []}
    loose, certificates = [], []
    facts = [f for f in sorted(facts, key=lambda f: f["position"]) if f["statement"] is not None]
    for f in facts:
        c = f["category"]
        text = f"{f['label']}: {f['statement']}" if f["label"] is not None else f["statement"]
        if c in ("role", "experience", "tech_stack") and f["entry"] is None and c != "role":
            loose.append(f)
        elif c in ("role", "experience", "tech_stack", "project_entry", "project", "project_stack"):
            e = (jobs if c in ("role", "experience", "tech_stack") else works).setdefault(f["entry"], {"head": [], "bullets": [], "stack": [], "employer": None})
            e["head" if c in ("role", "project_entry") else "stack" if c.endswith("stack") else "bullets"].append((f["position"], f["statement"] if c in ("role", "project_entry") else text))
            if c == "role":
                e["employer"] = f["employer"]
        elif c == "certification":
            certificates.append(f["statement"])
        elif c in ("summary", "skill_group", "education"):
            out["skills" if c == "skill_group" else c].append(f["statement"])
    for f in loose:
        for _, e in sorted(jobs.items()):
            if e["head"] and f["employer"] and e["employer"] and f["employer"].lower() == e["employer"].lower():
                text = f"{f['label']}: {f['statement']}" if f["label"] is not None else f["statement"]
                e["stack" if f["category"] == "tech_stack" else "bullets"].append((f["position"], text))
                break
    nested = lambda es: [x for _, e in sorted(es.items()) if e["head"] for x in [*(("entry", t) for _, t in sorted(e["head"])), *(("bullet", t) for _, t in sorted(e["bullets"])), *(("bullet", t) for _, t in sorted(e["stack"]))]]
    parts = {n: [("text", x) for x in xs] for n, xs in out.items()} | {"experience": nested(jobs), "projects": nested(works)}
    parts["education"] += [("text", c) for c in certificates]
    order = [s for s in dict.fromkeys(wanted or []) if s in assembly.SECTIONS]
    order += [s for s in assembly.SECTIONS if s not in order]
    return [x for s in order if parts[s] for x in [("section", assembly.SECTIONS[s]), *parts[s]]]


def blocks(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r[0], []).append((r.place, r.kind, r.text))
    return {k: [(kind, text) for _, kind, text in sorted(v)] for k, v in out.items()}


def test_documents_of_profiles(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    facts = matched._facts(t).where("doc_id < 40").select("doc_id", "position", "category", "statement", "entry", "item", "label", "employer").cache()
    order = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("projects"), F.lit("hobbies"), F.lit("summary"), F.lit("projects"))).alias("section_order"))
    by: dict = {}
    for r in facts.collect():
        by.setdefault(r.doc_id, []).append(r.asDict())
    want = {k: plain(v, ["projects", "hobbies", "summary", "projects"] if k % 2 == 0 else None) for k, v in by.items()}
    assert len(want) > 20 and blocks(assembly.base_blocks(facts, "doc_id", order)) == want


def test_added_and_odd_facts(spark):
    rows = [
        (1, 0, "role", "Lead at Acme", 3, None, None, "Acme"), (1, 1, "experience", "did", 3, 0, "What", "Acme"), (1, 2, "tech_stack", "Spark", 3, 1, "Stack", "Acme"), (1, 3, "role", "Dev at Acme", 1, None, None, "ACME"), (1, 9, "experience", "added", None, None, None, "acme"), (1, 10, "experience", "lost", None, None, None, "other"),
        (1, 11, "experience", "headless", 7, 0, None, None), (1, 12, "project", "of no project", 0, 0, None, None), (1, 4, "certification", "C1", 0, None, None, None), (1, 5, "education", "E1", 0, None, None, None), (1, 6, "unknown", "x", 0, None, None, None), (1, 7, "summary", None, 0, None, None, None),
        (2, 0, "skill_group", "Tools: a", 0, None, "Tools", None),
    ]
    df = spark.createDataFrame(rows, FACT)
    names = [c.split()[0] for c in FACT.split(", ")]
    got = blocks(assembly.base_blocks(df, "k"))
    assert got == {k: plain([dict(zip(names, r)) for r in rows if r[0] == k], None) for k in (1, 2)}
    assert got[1][:4] == [("section", "Experience"), ("entry", "Dev at Acme"), ("bullet", "added"), ("entry", "Lead at Acme")]
    assert assembly.base_blocks(df.limit(0), "k").collect() == []


def test_parts_of_a_fit(spark):
    items = [(1, "required", 1.0, 1, True), (1, "context", 0.0, 1, True), (1, "preferred", None, 1, True), (1, "required", 0.5, 0, True), (2, "required", None, 1, True), (3, None, 0.4, 2, None)]
    got = {r.k: r.skills for r in matching.items_fit(spark.createDataFrame(items, "k long, kind string, score double, n_terms int, technical boolean"), ["k"]).collect()}
    assert got == {1: 83.3, 2: 50.0, 3: 40.0}
    rows = [("data_engineering", 0.9, None), ("data_engineering", None, "software"), ("data_engineering", 0.9, "software"), ("data_engineering", 0.9, "analytics"), ("platform_infrastructure", 0.9, "platform"), ("platform_infrastructure", 0.9, None), ("platform_infrastructure", 0.9, "data_engineering"), ("adjacent_data", 0.9, "analytics"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, r double, f string").select(matching.role_fit(F.col("c"), F.col("r"), F.col("f"), ["data_engineering"], ["data_engineering", "platform_infrastructure"]).alias("s"))
    assert [r.s for r in df.collect()] == [90.0, 50.0, 70.0, 55.0, 70.0, 50.0, 75.0, 45.0, 25.0]


def test_gaps_with_alternatives(spark):
    skills = [("a", "GAP", "required", ["R1"]), ("b", "GAP", "required", ["R1", "R2"]), ("c", "GAP", "preferred", []), ("d", "STRONG", "required", ["R1"]), ("e", "GAP", "required", None), ("f", "GAP", "required", ["R9"])]
    must = [("R1", "any", "MET"), ("R2", "all", "MET")]
    df = spark.createDataFrame([(skills, must), (None, None)], "s array<struct<name: string, status: string, importance: string, requirement_ids: array<string>>>, r array<struct<id: string, mode: string, status: string>>")
    first, second = df.select(matching.split_gaps(F.col("s"), F.col("r")).alias("x")).collect()
    assert {s.name: s.importance for s in first.x} == {"a": "alternative", "b": "required", "c": "preferred", "d": "required", "e": "required", "f": "required"} and second.x == []


def test_profiles_and_documents_meet(spark):
    """What profiles read is what a document of their facts says again."""
    text = "Summary\nBuilds. Ships.\nExperience\nAcme Labs\nLead Engineer\n2019 - Present\n• did one\n• Stack: Spark\nSkills\nTools: a, b\nEducation\nUniversity of X"
    facts = profiles.facts(profiles.profiles(spark.createDataFrame([(1, text)], "k long, text string"), "k", "text"), "k")
    assert blocks(assembly.base_blocks(facts, "k"))[1] == [
        ("section", "Summary"), ("text", "Builds."), ("text", "Ships."), ("section", "Experience"), ("entry", "Lead Engineer at Acme Labs (2019 - Present)"), ("bullet", "did one"), ("bullet", "Stack: Spark"), ("section", "Skills"), ("text", "Tools: a, b"), ("section", "Education"), ("text", "University of X"),
    ]


def test_columns_that_no_document_shows_are_not_computed(spark):
    rows = [(1, "summary", "S.", None, None, None, None, 0)]
    facts = spark.createDataFrame(rows, "k long, category string, statement string, entry int, item int, label string, employer string, position int")
    facts = facts.withColumn("technologies", F.raise_error(F.concat(F.lit("not needed: "), "statement")).cast("array<string>"))
    assert [r.text for r in assembly.base_blocks(facts, "k").orderBy("place").collect()] == ["Summary", "S."]
