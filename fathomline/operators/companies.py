"""Companies: names and domains, lifecycle, frontier points and target scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

#: Words that close a legal name, and endings that a name may share with a domain.
LEGAL = ["inc", "incorporated", "llc", "llp", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "plc", "gmbh", "ag", "sa", "bv", "nv", "pte", "pty", "sas", "oy", "ab", "srl", "spa", "kk", "and"]
TLDS = "com|in|io|ai|co|net|org|app|dev|tech|jobs"
LABEL_ENDS = ["careers", "career", "jobs", "group", "global", "inc", "corp", "tech", "hq", "india", "chase", "co", "app", "labs", "ai", "io", "hr", "official", "online", "pay"]
GENERIC_ENDS = ["technologies", "technology", "software", "solutions", "systems", "labs", "india", "group", "services", "global", "holdings", "networks", "digital", "consulting", "analytics", "financial", "finance", "payments", "platforms", "ventures", "and"]

#: Letters with marks and the plain letter each stands for.
_MARKED, _PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normal_name(name: Column) -> Column:
    """Lower case without marks, brackets, a domain ending and legal words at the end."""
    low = F.translate(F.lower(name), _MARKED, _PLAIN)
    low = F.regexp_replace(F.trim(F.regexp_replace(low, r"\(.*?\)", " ")), rf"\.({TLDS})$", "")
    words = F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, rf"^(.+?)(?: (?:{'|'.join(LEGAL)}))+$", "$1")


def name_key(name: Column) -> Column:
    return F.replace(normal_name(name), F.lit(" "), F.lit(""))


def domain_evidence(name: Column, domain: Column) -> Column:
    """How far a domain's first label speaks for a name: 1 the same, 0.8 with a known ending, 0.7 the start of a longer name, else 0."""
    key, label = name_key(name), F.replace(F.split_part(F.lower(domain), F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    n = F.char_length(label)
    words = F.split(normal_name(name), " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(F.array_join(F.slice(words, 1, k), "").alias("head"), F.slice(words, k + 1, F.size(words)).alias("rest")))
    start = F.exists(heads, lambda h: (h["head"] == label) & F.forall(h["rest"], lambda w: w.isin(*GENERIC_ENDS)))
    ended = (F.char_length(key) >= 4) & F.startswith(label, key) & F.substring(label, F.char_length(key) + 1, n).isin(*LABEL_ENDS)
    score = F.when((key == "") | (label == ""), 0.0).when(label == key, 1.0).when(ended, 0.8).when((n >= 4) & start, 0.7).otherwise(0.0)
    return F.coalesce(score, F.lit(0.0))


def lifecycle(ignored: Column, roles: Column, succeeded: Column, complete: Column) -> Column:
    return F.when(ignored, "INACTIVE").when((roles > 0) & succeeded, "ACTIVE").when(succeeded & complete, "INACTIVE").when(succeeded, "VERIFIED").otherwise("UNVERIFIED")


def frontier_points(df: DataFrame) -> DataFrame:
    """Adds the points that apply as a map, and their sum as priority."""
    most = F.greatest("data_roles", "hiring_signals")
    holds = {
        "de_openings_5plus": most >= 5,
        "de_openings_3plus": (most >= 3) & (most < 5),
        "de_openings_1plus": (most >= 1) & (most < 3),
        "hiring_post": F.col("hiring_posts") > 0,
        "hiring_campaign": F.col("hiring_sources") >= 2,
        "india_presence": F.col("india_presence"),
        "product_company": F.col("product_company"),
        "fresh_signal": F.col("signal_age_hours") <= 48,
        "seed": F.col("is_seed"),
    }
    pairs = [F.when(cond, F.struct(F.lit(name).alias("k"), F.lit(float(scores.FRONTIER[name])).alias("v"))) for name, cond in holds.items()]
    points = F.array_compact(F.array(*pairs))
    return df.withColumns({"points": F.map_from_entries(points), "priority": F.aggregate(points, F.lit(0.0), lambda s, p: s + p["v"])})


def target_parts(df: DataFrame) -> dict[str, Column]:
    """The parts of a company's target score, with neutral values for what is unknown.

    `df` has open_roles, fresh_roles, best_fit (mean of the three best), discovery
    (map), tier, kind (text), pay_known, pay_match, places, places_ok, india,
    remote, terms, terms_known.
    """
    c = F.col
    known = lambda name, default: F.coalesce(F.try_element_at(c("discovery"), F.lit(name)), F.lit(default))
    hiring = F.least(F.lit(100.0), 20.0 * c("open_roles") + 15.0 * c("fresh_roles"))
    tier = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in scores.TIERS.items() for x in pair)), c("tier")), F.lit(scores.TIER_UNKNOWN))
    return {
        "hiring_activity": F.when(c("open_roles") > 0, hiring).otherwise(F.least(hiring, known("data_hiring_signal", 0.0))),
        "role_relevance": F.coalesce("best_fit", known("role_relevance", 50.0)),
        "engineering_quality": known("engineering_quality", 50.0),
        "product_quality": F.when(F.lower("kind").rlike("product|startup|saas|software"), 80.0).otherwise(50.0),
        "career_growth": 0.5 * tier + 0.5 * known("growth_potential", 50.0),
        "compensation_potential": F.when(~c("pay_known"), 50.0).when(c("pay_match"), 85.0).otherwise(40.0),
        "india_remote_fit": F.when(c("places") > 0, 100.0 * c("places_ok") / c("places")).when(c("india"), 85.0).when(c("remote"), 75.0).otherwise(50.0),
        "technical_relevance": F.when(c("terms") > 0, 100.0 * c("terms_known") / c("terms")).otherwise(50.0),
    }


def target_score(df: DataFrame, own_employer: Column) -> DataFrame:
    parts = {n: scores.one_decimal(p) for n, p in target_parts(df).items()}
    value = scores.weighted_mean(parts, scores.TARGET)
    capped = F.when(own_employer, F.least(value, F.lit(scores.EMPLOYER_CAP))).otherwise(value)
    return df.withColumn("target_score", scores.one_decimal(capped))


#: Hours within which hiring counts as of the last days.
LAST_DAYS = 168


def summaries(companies: DataFrame, events: DataFrame, fresh_hours: float, most_events: int = 2, most_similar: int = 3) -> DataFrame:
    """company_id, summary: what speaks for a company, a line for each, or a line that nothing is known yet.

    `companies` has company_id, is_seed, data_roles, platform_roles,
    fresh_roles, recent_roles, signal_age_hours, india_presence, remote_presence,
    product_company, similar_to (array); nulls count as nothing. `events` has company_id, event_id,
    reason, status, confidence, source, role (may be null); seeds, career pages and ignored
    ones aren't told, and of the others the most confident are, ties by id.
    """
    told = events.where(~F.coalesce(F.col("reason").isin("MANUAL_SEED", "CAREER_PAGE"), F.lit(False)) & ~F.coalesce(F.col("status") == "IGNORED", F.lit(False)))
    line = F.concat(F.coalesce("reason", F.lit("event")), F.lit(" by "), F.coalesce("source", F.lit("unknown")), F.coalesce(F.concat(F.lit(" for "), F.col("role")), F.lit("")))
    best = told.select("company_id", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("event_id"), line.alias("line")).alias("e")).groupBy("company_id").agg(F.transform(F.slice(F.array_sort(F.collect_list("e")), 1, most_events), lambda e: e["line"]).alias("_events"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    similar = F.slice(F.array_sort(F.array_distinct(F.coalesce("similar_to", F.array().cast("array<string>")))), 1, most_similar)
    recent = (n("recent_roles") > 0) | F.coalesce(F.col("signal_age_hours") <= LAST_DAYS, F.lit(False))
    lines = F.array_compact(F.array(
        F.when(yes("is_seed"), "added by hand"),
        F.when(n("data_roles") > 0, F.concat(F.col("data_roles").cast("string"), F.lit(" openings for data engineers"))),
        F.when(n("platform_roles") > 0, F.concat(F.col("platform_roles").cast("string"), F.lit(" openings for platforms"))),
        F.when(n("fresh_roles") > 0, F.lit(f"hiring within {fresh_hours:g} hours")).when(recent, F.lit("hiring within 7 days")),
        F.when(yes("india_presence"), "present in India"),
        F.when(yes("remote_presence"), "remote roles"),
        F.when(yes("product_company"), "makes products"),
        F.when(F.size(similar) > 0, F.concat(F.lit("named beside "), F.array_join(similar, ", "))),
    ))
    rows = companies.join(best, "company_id", "left")
    whole = F.concat(lines, F.coalesce("_events", F.array().cast("array<string>")))
    return rows.select("company_id", F.when(F.size(whole) > 0, F.array_join(whole, "\n")).otherwise("nothing is known yet").alias("summary"))
