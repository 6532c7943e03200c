"""Why a fit is as it is, and how to apply: lists of findings, each with its rule and the names that it is about.

Everything works on the arrays of one row, so there is neither a join nor a
shuffle. Arrays keep the order they come in unless a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fit from which an application is strong in spite of gaps.
STRONG_FIT = 70
#: Names that each list has at most.
GAPS, ALTERNATIVES, TRANSFERABLE, OTHERS = 5, 4, 2, 4
EMPHASISED_REQUIRED, EMPHASISED, PLAYED_DOWN, CONCERNS = 6, 8, 6, 8

FINDING = "struct<rule: string, names: array<string>, text: string>"


def _names(skills: Column, keep, most: int) -> Column:
    return F.slice(F.transform(F.filter(skills, keep), lambda s: s["name"]), 1, most)


def _finding(rule: str, names: Column | None = None, text: Column | None = None) -> Column:
    names = F.array().cast("array<string>") if names is None else names
    return F.struct(F.lit(rule).alias("rule"), names.alias("names"), (F.lit(None).cast("string") if text is None else text).alias("text")).cast(FINDING)


def _listed(names: Column, before: str) -> Column:
    return F.concat(F.lit(f"{before}: "), F.array_join(names, ", "))


def findings(skills: Column, requirements: Column, fit: Column, seniority: Column, location: Column, on_target: Column, title: Column) -> Column:
    """array<struct(rule, names, text)> in a fixed order; rules that don't apply are left out.

    `skills` is array<struct(name, status, importance, note, requirement_ids)>,
    `requirements` array<struct(kind, status, score)>; null arrays count as empty. A
    missing required skill is a gap of requirements if one of its requirement ids starts with R, else of duties.
    `on_target` says that role and focus are what is looked for, `title` names the present work.
    """
    skills, requirements = (F.coalesce(c, F.array()) for c in (skills, requirements))
    asked = lambda s: F.exists(F.coalesce(s["requirement_ids"], F.array().cast("array<string>")), lambda r: r.startswith("R"))
    gap = lambda importance: lambda s: (s["status"] == "GAP") & (s["importance"] == importance)
    every = 1_000_000
    required, duties = _names(skills, lambda s: gap("required")(s) & asked(s), every), _names(skills, lambda s: gap("required")(s) & ~asked(s), every)
    preferred, others = _names(skills, gap("preferred"), every), _names(skills, gap("alternative"), every)
    must = F.filter(requirements, lambda r: (r["kind"] == "required") & r["score"].isNotNull())
    met = F.size(F.filter(must, lambda r: r["status"].isin("MET", "PARTIAL")))
    near = F.slice(F.filter(skills, lambda s: s["status"] == "TRANSFERABLE"), 1, TRANSFERABLE)
    project = _names(skills, lambda s: (s["status"] == "PROJECT") & (s["importance"] == "required"), OTHERS)
    past = _names(skills, lambda s: s["status"] == "HISTORICAL", OTHERS)
    first = lambda names, n: F.slice(names, 1, n)
    some = lambda names: F.size(names) > 0
    said = [
        F.when(F.size(must) > 0, _finding("met", None, F.concat(met.cast("string"), F.lit(" of "), F.size(must).cast("string"), F.lit(" required items are covered, wholly or in part")))),
        F.when(some(preferred) & ~some(required) & ~some(duties), _finding("preferred gaps only", first(preferred, GAPS), _listed(first(preferred, GAPS), "Only preferred skills are missing"))),
        F.when(some(required), _finding("required gaps", first(required, GAPS), _listed(first(required, GAPS), "No evidence for required skills"))),
        F.when(some(duties), _finding("duty gaps", first(duties, GAPS), _listed(first(duties, GAPS), "Duties that nothing shows yet"))),
        F.when(some(others), _finding("alternatives", first(others, ALTERNATIVES), _listed(first(others, ALTERNATIVES), "Not missing, as alternatives are accepted"))),
        F.when(F.coalesce(on_target, F.lit(False)), _finding("focus", None, F.concat(F.lit("The role's focus fits "), F.coalesce(F.concat(F.lit("present work as "), title), F.lit("the roles looked for"))))),
    ]
    after = [
        F.when(some(project), _finding("projects only", project, _listed(project, "Shown by projects and not in production"))),
        F.when(some(past), _finding("not recent", past, _listed(past, "Used in the past"))),
        F.when(seniority.isin("STRETCH", "UNDERQUALIFIED", "OVERQUALIFIED"), _finding("seniority", F.array(seniority), F.concat(F.lit("Seniority: "), F.lower(F.replace(seniority, F.lit("_"), F.lit(" ")))))),
        F.when(location.isin("MISMATCH", "RELOCATION"), _finding("location", F.array(location), F.concat(F.lit("Location: "), F.lower(location)))),
        F.when((fit >= STRONG_FIT) & (some(required) | some(preferred)), _finding("strong all the same", None, F.lit("What weighs most is shown in production; name the gaps openly"))),
    ]
    each = F.transform(near, lambda s: F.struct(F.lit("transferable").alias("rule"), F.array(s["name"]).alias("names"), F.concat_ws(": ", s["name"], s["note"]).alias("text")).cast(FINDING))
    return F.concat(F.array_compact(F.array(*said)), each, F.array_compact(F.array(*after)))


#: Which skills are a concern, by status and importance (null: any), in the order of skills.
WORRIES = [("GAP", "required", "missing"), ("TRANSFERABLE", None, "transferable"), ("HISTORICAL", None, "not recent"), ("PROJECT", "required", "projects only"), ("LISTED", "required", "listed only")]
#: What to do about each concern.
ADVICE = {
    "missing": "Don't claim it; add it to the profile only if it was really used, else speak of how to learn it",
    "transferable": "Lead with the related work under its own name",
    "not recent": "Give it with its dates, and not as present work",
    "projects only": "Leave it among projects",
    "listed only": "Leave it in the list, and have an example ready",
    "seniority": "Show ownership that the profile already has; titles and years stay as they are",
    "location": "Settle place and relocation before applying",
}


def strategy(skills: Column, boosts: Column, own: Column, seniority: Column, location: Column) -> Column:
    """struct(emphasise, play_down, concerns) for an application.

    `skills` is array<struct(name, status, importance, weight)> of what is asked
    for, `boosts` map<term, number> of what the company values, `own`
    array<struct(name, level, production)> of what the profile shows. Emphasised are the required skills that are STRONG or MODERATE, the
    heaviest first (ties as they come), then boosted terms with production
    evidence, the most boosted first (ties by name). Played down are own skills LISTED or of a PROJECT
    that nobody asks for. Concerns are array<struct(rule, names, text)>.
    """
    skills, own = F.coalesce(skills, F.array()), F.coalesce(own, F.array())
    numbered = F.transform(skills, lambda s, i: F.struct((-F.coalesce(s["weight"], F.lit(1.0))).alias("w"), i.alias("i"), s["name"].alias("name"), s["status"].alias("status"), s["importance"].alias("importance")))
    must = F.filter(F.array_sort(numbered), lambda s: (s["importance"] == "required") & s["status"].isin("STRONG", "MODERATE"))
    first = F.slice(F.transform(must, lambda s: F.struct(s["name"].alias("term"), F.lit("required").alias("why"))), 1, EMPHASISED_REQUIRED)
    shown = F.transform(F.filter(own, lambda o: o["level"].isin("STRONG", "MODERATE") | F.coalesce(o["production"], F.lit(False))), lambda o: o["name"])
    raised = F.array_sort(F.transform(F.map_entries(F.coalesce(boosts, F.create_map().cast("map<string, double>"))), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("name"))))
    named = F.transform(first, lambda e: e["term"])
    valued = F.filter(raised, lambda b: F.array_contains(shown, b["name"]) & ~F.coalesce(F.array_contains(named, b["name"]), F.lit(False)))
    emphasise = F.slice(F.concat(first, F.transform(valued, lambda b: F.struct(b["name"].alias("term"), F.lit("valued").alias("why")))), 1, EMPHASISED)
    asked = F.transform(skills, lambda s: s["name"])
    play_down = F.slice(F.transform(F.filter(own, lambda o: o["level"].isin("LISTED", "PROJECT") & ~F.coalesce(F.array_contains(asked, o["name"]), F.lit(False))), lambda o: o["name"]), 1, PLAYED_DOWN)

    def worry(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for status, importance, rule in reversed(WORRIES):
            holds = (s["status"] == status) & (F.lit(True) if importance is None else s["importance"] == importance)
            out = F.when(holds, rule).otherwise(out)
        return out

    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    named_worries = F.filter(F.transform(skills, lambda s: F.struct(worry(s).alias("rule"), s["name"].alias("name"))), lambda w: w["rule"].isNotNull())
    worries = F.transform(named_worries, lambda w: F.struct(w["rule"].alias("rule"), F.array(w["name"]).alias("names"), F.try_element_at(advice, w["rule"]).alias("text")).cast(FINDING))
    rest = F.array_compact(F.array(
        F.when(seniority.isin("STRETCH", "UNDERQUALIFIED"), _finding("seniority", F.array(seniority), F.lit(ADVICE["seniority"]))),
        F.when(location.isin("RELOCATION", "UNKNOWN"), _finding("location", F.array(location), F.lit(ADVICE["location"]))),
    ))
    return F.struct(emphasise.alias("emphasise"), play_down.alias("play_down"), F.slice(F.concat(worries, rest), 1, CONCERNS).alias("concerns"))
