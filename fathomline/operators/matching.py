"""Candidate evidence against job requirements, for many candidates and jobs at once.

Facts, terms, requirements and preferences are tables keyed by candidate and
job, so each step is a join or an aggregation over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import one_decimal, weighted_mean

#: What a level of evidence counts, and the share that passes to the family's other members.
LEVELS = {"STRONG": 1.0, "MODERATE": 0.8, "RUSTY": 0.6, "PROJECT": 0.5, "LISTED": 0.4}
TRANSFER_LEVELS = ["STRONG", "MODERATE", "RUSTY"]
#: Verdicts from the gravest, with their scores.
VERDICTS = [("UNDERQUALIFIED", 25.0), ("STRETCH", 65.0), ("OVERQUALIFIED", 60.0), ("STRONG_MATCH", 100.0)]


def expand_terms(facts: DataFrame, implied: DataFrame, term: str = "term") -> DataFrame:
    """Facts with every term that theirs imply, each once; `implied` is a closed (source, target) table."""
    more = facts.join(implied.select(F.col("source").alias(term), F.col("target").alias("_t")), term).withColumn(term, F.col("_t")).drop("_t")
    return facts.unionByName(more).distinct()


def skill_evidence(facts: DataFrame, now_month: int, rusty_after: float = 3.0) -> DataFrame:
    """Per candidate and skill the level that its facts show.

    `facts` has candidate, fact_id, term, category, employer, end_month (an index;
    null unknown). Use at an employer outranks projects, which outrank lists; use
    that ended more than `rusty_after` years ago is rusty.
    """
    used = F.col("category").isin("experience", "tech_stack", "role")
    project = F.col("category").isin("project", "project_stack", "project_entry")
    listed = F.col("category").isin("skill_group", "certification")
    out = facts.groupBy("candidate", "term").agg(
        F.count_distinct(F.when(used, F.coalesce("employer", F.lit("unknown employer")))).alias("roles"),
        F.count_if(F.col("category") == "experience").alias("mentions"),
        F.count_if(project).alias("projects"),
        F.coalesce(F.bool_or(listed), F.lit(False)).alias("listed"),
        F.max(F.when(used, F.col("end_month"))).alias("last_month"),
    )
    score = 2.0 * F.col("roles") + 1.5 * F.col("mentions") + F.when(F.col("listed"), 0.5).otherwise(0.0) + F.least(F.lit(1.0), 0.5 * F.col("projects"))
    idle = (F.lit(now_month) - F.col("last_month")) / 12
    level = F.when((F.col("roles") > 0) & (idle > rusty_after), "RUSTY").when((F.col("roles") > 0) & (F.col("score") >= 3.5), "STRONG").when(F.col("roles") > 0, "MODERATE").when(F.col("projects") > 0, "PROJECT").otherwise("LISTED")
    return out.withColumn("score", score).withColumn("level", level)


def assess_terms(wanted: DataFrame, skills: DataFrame, families: DataFrame) -> DataFrame:
    """Score of each wanted (candidate, job, requirement, term): own evidence, else the best peer of its family, else a gap.

    `families` has term, family, transfer. Of equally good peers the first by name counts.
    """
    level_score = F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("level"))
    own = skills.select("candidate", "term", F.col("level").alias("_level"), level_score.alias("_own"))
    peers = skills.where(F.col("level").isin(*TRANSFER_LEVELS)).join(families, "term").select("candidate", "family", F.col("term").alias("_peer"), F.round(F.col("transfer") * level_score, 2).alias("_score"))
    order = Window.partitionBy("candidate", "family").orderBy(F.desc("_score"), F.asc("_peer"))
    peers = peers.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    rows = wanted.join(own, ["candidate", "term"], "left").join(families.select("term", "family"), "term", "left").join(peers, ["candidate", "family"], "left")
    status = F.when(F.col("_level").isNotNull(), F.col("_level")).when(F.col("_score") > 0, "TRANSFERABLE").otherwise("GAP")
    return rows.select(*wanted.columns, F.coalesce("_own", "_score", F.lit(0.0)).alias("score"), status.alias("status"), F.when(status == "TRANSFERABLE", F.col("_peer")).alias("via"))


def requirement_scores(terms: DataFrame, keys: list[str], mode: str = "mode") -> DataFrame:
    """Per requirement the best of its terms where any will do, else their mean."""
    out = terms.groupBy(*keys, mode).agg(F.max("score").alias("_best"), F.avg("score").alias("_mean"))
    return out.withColumn("score", F.when(F.col(mode) == "any", F.col("_best")).otherwise(F.col("_mean"))).drop("_best", "_mean")


def skills_fit(terms: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weighted mean of term scores in percent; 50 where nothing weighs."""
    total = F.sum(weight)
    return terms.groupBy(*keys).agg(F.when(total > 0, 100.0 * F.sum(F.col("score") * F.col(weight)) / total).otherwise(50.0).alias("skills_fit"))


def years_fit(years: Column, needed: Column) -> Column:
    return F.when(years.isNull(), 0.5).when(years >= needed, 1.0).when(years >= needed - 1, 0.7).otherwise(0.25)


def location_fit(jobs: DataFrame, key: str, location: str, cities: list[str], remote_ok: bool, home: str, wants_home: bool, relocation: bool) -> DataFrame:
    """Best fit over a posting's places, as (status, score). Without preferences or places it is UNKNOWN, 60."""
    places = F.filter(F.transform(F.split(F.coalesce(location, F.lit("")), r";|\|| / "), lambda p: F.lower(F.trim(p))), lambda p: ~p.isin("", "unknown"))

    def fit(p: Column) -> Column:
        at_home, remote = p.contains(home.lower()), p.contains("remote")
        city = F.lit(False)
        for name in cities:
            city = city | p.contains(name.lower())
        anywhere = remote & (at_home | p.rlike(r"^\W*remote\W*$")) & F.lit(remote_ok)
        score = F.when(city, 100.0).when(anywhere, 95.0).when(at_home & F.lit(wants_home), 85.0).when(remote & ~at_home & F.lit(remote_ok), 10.0).when(F.lit(relocation), 40.0).otherwise(0.0)
        status = F.when(score >= 85, "MATCH").when(score == 40, "RELOCATION").otherwise("MISMATCH")
        return F.struct(score.alias("score"), status.alias("status"))

    best = F.array_max(F.transform(places, fit))
    known = (F.size(places) > 0) & F.lit(bool(cities or remote_ok or wants_home))
    return jobs.select(key, F.when(known, best["status"]).otherwise("UNKNOWN").alias("status"), F.when(known, best["score"]).otherwise(60.0).alias("score"))


def compensation_fit(top: Column, currency: Column, wanted: float | None, wanted_currency: str | None) -> Column:
    """struct(status, score) of a published maximum against the wanted minimum."""
    if wanted is None or not wanted_currency:
        return F.struct(F.lit("UNKNOWN").alias("status"), F.lit(60.0).alias("score"))
    known = top.isNotNull() & (currency == wanted_currency.upper())
    status = F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN").when(top >= wanted, "MATCH").when(top >= 0.85 * wanted, "CLOSE").otherwise("BELOW")
    score = F.when(status == "MATCH", 100.0).when(status == "CLOSE", 70.0).when(status == "BELOW", 35.0).otherwise(60.0)
    return F.struct(status.alias("status"), score.alias("score"))


def seniority_fit(years: Column, low: Column, high: Column, level: Column, wanted_level: Column) -> Column:
    """struct(status, score): the gravest verdict of years and of levels; UNKNOWN, 70 if neither can be compared."""
    by_years = F.when(years.isNull() | low.isNull(), None).when(years < low - 1.5, 0).when(years < low, 1).when(years > high + 3, 2).otherwise(3)
    gap = wanted_level - level
    by_level = F.when(gap.isNull(), None).when(gap >= 2, 0).when(gap == 1, 1).when(gap <= -2, 2).otherwise(3)
    worst = F.least(by_years, by_level)  # least passes over nulls
    names, values = F.array(*(F.lit(n) for n, _ in VERDICTS)), F.array(*(F.lit(v) for _, v in VERDICTS))
    return F.struct(F.coalesce(F.get(names, worst), F.lit("UNKNOWN")).alias("status"), F.coalesce(F.get(values, worst), F.lit(70.0)).alias("score"))


def composed_fit(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the components at hand, to one decimal; weights of components that aren't don't count."""
    return one_decimal(weighted_mean(parts, weights))


#: What an item weighs in the fit of skills by kind, and its share if it names no technology.
ITEM_WEIGHTS, NO_TECHNOLOGY = {"required": 1.0, "responsibility": 0.6, "preferred": 0.35}, 0.6
OTHER_ITEM = 0.2


def items_fit(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per match its fit of skills in percent, to one decimal, from its scored items (kind, score, n_terms, technical); 50 without any.

    Items without a score or without terms don't count. Sums are of decimals, so they don't depend on the order of rows.
    """
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in ITEM_WEIGHTS.items()), F.lit(OTHER_ITEM)) * F.when(F.coalesce("technical", F.lit(False)), 1.0).otherwise(NO_TECHNOLOGY)
    counts = F.col("score").isNotNull() & (F.coalesce("n_terms", F.lit(0)) > 0)
    exact = lambda c: F.sum(F.when(counts, c.cast("decimal(18,9)")))
    total, mass = exact(F.col("score") * weight), exact(weight)
    return items.groupBy(*keys).agg(F.coalesce(one_decimal(100.0 * total.cast("double") / mass.cast("double")), F.lit(50.0)).alias("skills"))


def experience_fit(years: Column, needed: Column) -> Column:
    """By years against those asked for: 100 enough, 75 a year short or nothing asked, 60 unknown, 50 two years short, else 25."""
    return F.when(needed.isNull(), 75.0).when(years.isNull(), 60.0).when(years >= needed, 100.0).when(years >= needed - 1, 75.0).when(years >= needed - 2, 50.0).otherwise(25.0)


def role_fit(category: Column, relevance: Column, focus: Column, wanted: list[str], targets: list[str]) -> Column:
    """By the kind of role, capped where the work is of another kind than the title says."""
    base = F.when(category.isin(*wanted), 100.0 * F.least(F.lit(1.0), F.greatest(F.coalesce(relevance, F.lit(0.0)), F.lit(0.5)))).when(category.isin(*targets), 75.0).when(category == "adjacent_data", 45.0).otherwise(25.0)
    focus = F.coalesce(focus, F.lit(""))
    capped = (
        F.when((focus == "analytics") & (base > 55), 55.0)
        .when((focus != "analytics") & (category == "platform_infrastructure") & (focus != "data_engineering") & (base > 60), F.when(focus == "platform", 70.0).otherwise(50.0))
        .when((category == "data_engineering") & (focus == "software") & (base > 70), 70.0)
    )
    return one_decimal(F.coalesce(capped, base))


def domain_fit(named: Column, own: Column) -> Column:
    """100 for a shared subject, 55 for subjects that aren't shared, 70 where a posting names none."""
    named, own = F.coalesce(named, F.array().cast("array<string>")), F.coalesce(own, F.array().cast("array<string>"))
    return F.when(F.arrays_overlap(named, own), 100.0).when(F.size(named) > 0, 55.0).otherwise(70.0)


def split_gaps(skills: Column, requirements: Column) -> Column:
    """Skills (name, status, importance, requirement_ids), of which gaps become "alternative" where all their linked requirements take any of several and are met.

    `requirements` is array<struct(id, mode, status)>.
    """
    requirements = F.coalesce(requirements, F.array())

    def one(s: Column) -> Column:
        linked = F.filter(requirements, lambda r: F.coalesce(F.array_contains(s["requirement_ids"], r["id"]), F.lit(False)))
        free = (s["status"] == "GAP") & (F.size(linked) > 0) & F.forall(linked, lambda r: F.coalesce((r["mode"] == "any") & (r["status"] == "MET"), F.lit(False)))
        return s.withField("importance", F.when(free, "alternative").otherwise(s["importance"]))

    return F.transform(F.coalesce(skills, F.array()), one)
