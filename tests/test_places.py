from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fathomline.functions import names
from fathomline.operators import places, positioning, requirements

GAZETTEER = [("New York", 1), ("new-york city", 2), ("York", 3), ("São Paulo", 4), ("City of London", 5), ("london", 6), ("LONDON", 5), ("A b c d e", 8), ("", 9), (None, 10), ("Null", None)]
TEXTS = ["New York City of London", "york, new york; NEW  YORK city!", "são paulo / Sao Paulo", None, "", "a b c d e a b c d", "London" * 2, "x " * 3000 + "york", "city of  london york"]


def plain(text):
    """Every name at every word, the longest first; a name that ends within an earlier one is passed over."""
    words = lambda s: [w for w in re.split(r"[\W_]+", (s or "").lower()) if w]
    known: dict = {}
    for name, place in GAZETTEER:
        if words(name) and place is not None:
            known[tuple(words(name))] = min(place, known.get(tuple(words(name)), place))
    w, out, reach = words(text), [], 0
    for i in range(len(w)):
        n = max((n for n in range(1, 6) if tuple(w[i : i + n]) in known and i + n <= len(w)), default=0)
        if n and i + n > reach:
            out.append((i + 1, n, known[tuple(w[i : i + n])]))
            reach = i + n
    return out


@pytest.mark.parametrize("broadcast_names", [places.BROADCAST_NAMES, 0])
def test_places_equal_a_search_at_every_word(spark, broadcast_names):
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], "k long, text string, id string, n int").repartition(3)
    found = places.find_places(rows, "k", "text", spark.createDataFrame(GAZETTEER, "name string, place int"), broadcast_names)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.k, []).append((r.word, r.n, r.place))
    assert {k: sorted(v) for k, v in got.items()} == {i: plain(t) for i, t in enumerate(TEXTS) if plain(t)}


def test_no_names(spark):
    rows = spark.createDataFrame([(1, "new york")], "k long, text string")
    assert places.find_places(rows, "k", "text", spark.createDataFrame([], "name string, place int")).collect() == []


def test_country_hints(spark):
    cases = [(["Toronto, Canada", "navi MUMBAI", "India", "x"], ["CAN", "IND"]), (["usa / uk"], ["USA"]), (None, []), ([None, "UK"], ["GBR"]), ([], [])]
    df = spark.createDataFrame(cases, "p array<string>, want array<string>").withColumn("got", F.transform(places.country_hints(F.col("p"), names.INDIA), lambda h: h["code"]))
    assert all(r.got == r.want for r in df.collect())


def test_location_requirements(spark):
    many = "; ".join(f"Place {i}" for i in range(11)) + "; Berlin; Remote - EMEA; Remote"
    cases = [
        ("Pune, Germany; Remote", None, "", ("remote", ["India"], True, ["unspecified"])),
        (many, None, "", ("remote", ["Germany"], False, ["EMEA", "unspecified"])),
        ("Tokyo | London / Remote (US)", None, None, ("remote", ["Japan", "United Kingdom"], False, ["US"])),
        ("Paris", None, "x" * 3996 + " hybrid", ("unknown", ["France"], False, [])),
        ("Paris", None, "x" * 3900 + " hybrid", ("hybrid", ["France"], False, [])),
        (None, None, "On-site", ("onsite", [], False, [])),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "k int, location string, status string, text string")
    got = {r.k: r.n for r in df.select("k", requirements.location_requirements(F.col("location"), F.col("status"), F.col("text")).alias("n")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert (got[i].mode, got[i].countries, got[i].india, got[i].remote_regions) == want
    assert len(got[1].places) == 12
    all_ = df.select("k", requirements.location_requirements(F.col("location"), F.col("status"), F.col("text"), 9999, 99).alias("n")).collect()
    assert {r.k: (len(r.n.places), r.n.mode) for r in all_ if r.k in (1, 3)} == {1: (14, "remote"), 3: (1, "hybrid")}


def test_headings(spark):
    cases = {
        "Must-haves": "required", "You bring:": "required", "ABOUT YOU": "required", "What you’ll need": "required", "Pluses": "preferred", "Bonus points": "preferred", "What you'll do": "responsibility", "In this role, you will": "responsibility", "About Acme & Co.": None, "About Acme & Co": "context",
        "Pay transparency": "ignore", "Diversity, equity and inclusion": "ignore", "Job summary": "intro", "- Requirements": None, "Requirements are many.": None, "x" * 71: None, "": None, "Ideal candidate should have": "required",
    }
    df = spark.createDataFrame(list(cases.items()), "line string, want string").withColumn("got", requirements.heading_kind(F.col("line")))
    assert {r.line: r.got for r in df.collect()} == cases


def test_archetypes_and_boosts(spark):
    order = list(positioning.ARCHETYPES)
    hints = spark.createDataFrame([(a, order.index(a), w) for a, w in [("ai", "gpus"), ("fintech", "bank"), ("fintech", "payments"), ("data_platform", "data platform company"), ("startup", "seed"), ("ai", "bank")]], "archetype string, rank int, alias string")
    sources = [
        (1, "name", 0, "Bank of Seed"), (1, "text", 1, "a Data Platform Company"), (2, "name", 0, "x"), (2, "text", 1, "GPUs, then payments and a bank"), (3, "name", 0, None), (3, "text", 1, "banking"), (4, "text", 1, "seed"), (4, "name", 0, "seed money"), (5, "name", 0, ""),
    ]
    got = {r.k: (r.archetype, r.source, r.hint) for r in positioning.archetypes(spark.createDataFrame(sources, "k long, source string, rank int, text string"), "k", hints).collect()}
    assert got == {1: ("data_platform", "text", "Data Platform Company"), 2: ("fintech", "text", "payments"), 4: ("startup", "name", "seed")}
    rows = spark.createDataFrame([(1, "uber", "ai"), (2, None, "startup"), (3, "amazon", None), (4, None, None), (5, "none", "none")], "k long, company string, archetype string")
    profiles = {k.lower(): v for k, v in positioning.PROFILES.items()}
    signals, boosts = positioning.positions(rows, "k", positioning.signal_table(spark, profiles, "company"), positioning.signal_table(spark, positioning.ARCHETYPES, "archetype"), positioning.term_table(spark))
    listed, raised = {}, {}
    for r in sorted(signals.collect(), key=lambda r: (r.k, r.kind, r.place)):
        listed.setdefault(r.k, []).append(r.signal)
    for r in boosts.collect():
        raised.setdefault(r.k, {})[r.term] = r.boost
    for k, company, kind in [(r.k, r.company, r.archetype) for r in rows.collect()]:
        values = list(profiles.get(company, []))
        values += [v for v in positioning.ARCHETYPES.get(kind, []) if v not in values]
        want: dict = {}
        for v in values:
            for term in positioning.SIGNAL_TERMS.get(v.lower(), []):
                want[term] = want.get(term, 0) + 0.3
        assert listed.get(k, []) == values and raised.get(k, {}) == {t: round(min(w, 0.6), 2) for t, w in want.items()}


def test_nearest_label_ties(spark):
    vectors = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "z", 1.0), (3, "a", None), (4, None, 1.0)], "k long, term string, weight double")
    labels = spark.createDataFrame([("y", "a", 1.0), ("x", "b", 1.0), ("w", "a", 0.5)], "label string, term string, weight double")
    assert [(r.k, r.label, r.score) for r in positioning.nearest_label(vectors, "k", labels).where("score is not null").collect()] == [(1, "x", 1.0)]


def test_texts_stay_where_they_are(spark):
    rows = spark.createDataFrame([(1, "new york")], "k long, text string")
    found = places.find_places(rows, "k", "text", spark.createDataFrame(GAZETTEER, "name string, place int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(id" not in plan
