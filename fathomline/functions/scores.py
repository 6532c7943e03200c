"""Weighted scores, gates and caps, as column arithmetic with weights in the open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the opportunity score, which is not divided by their sum.
OPPORTUNITY = {"jd_fit": 0.30, "technical_value": 0.15, "freshness": 0.15, "company": 0.10, "compensation": 0.10, "role_alignment": 0.10, "application_friction": 0.10}
#: Classes from the best to the worst, with the least score and the least fit of each.
CLASSES = ["P0", "P1", "P2", "P3", "REJECT"]
THRESHOLDS = {"P0": (80.0, 75.0), "P1": (68.0, 65.0), "P2": (55.0, 55.0), "P3": (40.0, 0.0)}
PRIORITY = {"fit": 0.45, "company_target": 0.25, "freshness": 0.15, "career_value": 0.15}
#: Weights of the company target score, what a tier is worth, and the cap for one's own employer.
TARGET = {"hiring_activity": 0.20, "role_relevance": 0.15, "engineering_quality": 0.10, "product_quality": 0.10, "career_growth": 0.10, "compensation_potential": 0.05, "india_remote_fit": 0.15, "technical_relevance": 0.15}
TIERS = {"S": 100.0, "A": 85.0, "B": 70.0, "C": 55.0}
TIER_UNKNOWN = 50.0
EMPLOYER_CAP = 35.0
#: Points of the frontier.
FRONTIER = {"de_openings_5plus": 50, "de_openings_3plus": 35, "de_openings_1plus": 15, "hiring_post": 30, "hiring_campaign": 20, "india_presence": 15, "product_company": 10, "fresh_signal": 15, "seed": 25}
NOISY_CAP, VERIFIED_FLOOR = 0.99, 0.95


def weighted_mean(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.get(k, 0.0) for k in parts) or 1.0
    return weighted_sum(parts, weights) / F.lit(total)


def weighted_sum(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, part in parts.items():
        out = out + part * weights.get(name, 0.0)
    return out


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def one_decimal(value: Column) -> Column:
    """Rounded half up, through a decimal, so that every engine agrees."""
    return F.round(value.cast("decimal(20,6)"), 1).cast("double")


def data_hiring(roles: Column, signals: Column) -> Column:
    return F.least(F.lit(100.0), 20.0 * roles + 12.0 * F.least(signals, F.lit(4)))


def engineering_quality(jobs: Column, technologies: Column, platform_roles: Column) -> Column:
    """50 while nothing is known."""
    known = F.least(F.lit(100.0), 40.0 + 6.0 * F.least(technologies, F.lit(6)) + 6.0 * F.least(platform_roles, F.lit(3)))
    return F.when((jobs == 0) & (technologies == 0), 50.0).otherwise(known)


def recent_hiring(fresh: Column, recent: Column, age_hours: Column) -> Column:
    return F.when(fresh > 0, 100.0).when(recent > 0, 70.0).when(age_hours <= 48, 85.0).when(age_hours <= 168, 60.0).when(age_hours.isNotNull(), 25.0).otherwise(0.0)


def application_score(parts: dict[str, Column], ats: Column, salary: Column) -> Column:
    """The opportunity score of parts without compensation and friction, which are read off the posting."""
    easy, hard = ("greenhouse", "lever", "ashby", "recruitee", "smartrecruiters"), ("workday", "oracle", "oracle_taleo", "icims", "amazon_jobs")
    friction = F.when(ats.isin(*easy), 85.0).when(ats.isin(*hard), 55.0).otherwise(60.0)
    pay = F.when(F.coalesce(salary, F.lit("")) != "", 65.0).otherwise(45.0)
    return weighted_sum(parts | {"compensation": pay, "application_friction": friction}, OPPORTUNITY)


def priority_ordinal(score: Column, fit: Column, gated: Column, caps: list[tuple[str, Column]]) -> Column:
    """The place in CLASSES: rejected by a gate, else the first class whose bounds hold, never above the worst cap."""
    reached = F.lit(len(CLASSES) - 1)
    for i in range(len(THRESHOLDS) - 1, -1, -1):
        least_score, least_fit = THRESHOLDS[CLASSES[i]]
        reached = F.when((score >= least_score) & (fit >= least_fit), i).otherwise(reached)
    for name, holds in caps:
        reached = F.when(F.coalesce(holds, F.lit(False)), F.greatest(reached, F.lit(CLASSES.index(name)))).otherwise(reached)
    return F.when(F.coalesce(gated, F.lit(False)), len(CLASSES) - 1).otherwise(reached)


def class_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in CLASSES)), ordinal + 1)


def requirement_status(score: Column) -> Column:
    return F.when(score >= 0.85, "MET").when(score >= 0.5, "PARTIAL").when(score > 0.15, "WEAK").otherwise("GAP")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal; null for an empty whole."""
    return F.when(whole > 0, one_decimal(100.0 * part / whole))
