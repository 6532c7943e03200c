"""Tables that change by key, as functions of the old state and a batch. Nulls of a batch never overwrite what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .evidence import changed
from .ranked import latest

#: Fields of a posting that a refresh takes over where the batch has a value.
REFRESHED = ["title", "description", "location", "application_url", "salary", "employment_type"]


def refresh(old: DataFrame, new: DataFrame, key: str, fields: list[str] = REFRESHED) -> DataFrame:
    """`old` with the values of `new` that aren't null, and whether any differs.

    remote_status unknown counts as null, and posted_at is set once. `new` has one
    row for each key; keys that it lacks stay as they are.
    """
    sides = [c for c in [*fields, "remote_status", "posted_at"] if c in old.columns and c in new.columns]
    batch = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in sides), F.lit(True).alias("_seen"))
    rows = old.join(batch, F.col(key) == F.col("_key"), "left")

    def value(c: str) -> Column:
        mine, theirs = F.col(c), F.col(f"_new_{c}")
        if c == "posted_at":
            return F.coalesce(mine, theirs)
        return F.coalesce(F.when(theirs != "unknown", theirs) if c == "remote_status" else theirs, mine)

    differs = changed([(F.col(c), value(c)) for c in sides])
    return rows.select(*(value(c).alias(c) if c in sides else c for c in old.columns), differs.alias("changed"), F.coalesce("_seen", F.lit(False)).alias("seen"))


def upsert_companies(state: DataFrame, signals: DataFrame, fields: list[str], most_aliases: int = 20) -> DataFrame:
    """Companies by name_key: missing fields are filled from the earliest signal that has them, new names become aliases.

    `state` has name_key, name, aliases and the fields; `signals` name_key, name, at
    and the fields. Signals without a key are left out. The earliest signal names a
    new company.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))["v"].alias(f"_new_{c}")
    batch = signals.where(F.coalesce("name_key", F.lit("")) != "").groupBy("name_key").agg(*(first(c) for c in ["name", *fields]), F.array_sort(F.collect_set("name")).alias("_names"))
    rows = state.join(batch, "name_key", "full")
    name = F.coalesce("name", "_new_name")
    empty = F.array().cast("array<string>")
    more = F.array_except(F.coalesce("_names", empty), F.array(name))
    aliases = F.slice(F.array_union(F.coalesce("aliases", empty), more), 1, most_aliases)
    return rows.select("name_key", name.alias("name"), aliases.alias("aliases"), *(F.coalesce(c, f"_new_{c}").alias(c) for c in fields), F.col("name").isNull().alias("created"))


def upsert_seeds(state: DataFrame, seeds: DataFrame, default_tier: str = "B") -> DataFrame:
    """Companies by name_key with the named ones as accepted seeds; a tier given by the user replaces the old one.

    Ignored companies that were inactive are discovered again. `state` has
    name_key, name, tier, status, review_status, is_seed.
    """
    given = seeds.groupBy("name_key").agg(F.max("tier").alias("_tier"), F.min("name").alias("_name")).withColumn("_seed", F.lit(True))
    rows = state.join(given, "name_key", "full")
    seed, again = F.coalesce("_seed", F.lit(False)), (F.col("review_status") == "IGNORED") & (F.col("status") == "INACTIVE")
    return rows.select(
        "name_key",
        F.coalesce("name", "_name").alias("name"),
        F.coalesce("_tier", "tier", F.lit(default_tier)).alias("tier"),
        F.when(F.col("status").isNull() | (seed & F.coalesce(again, F.lit(False))), "DISCOVERED").otherwise(F.col("status")).alias("status"),
        F.when(seed, "ACCEPTED").otherwise(F.col("review_status")).alias("review_status"),
        (seed | F.coalesce("is_seed", F.lit(False))).alias("is_seed"),
    )


def upsert_sources(state: DataFrame, found: DataFrame) -> DataFrame:
    """Career sources by (company, url): known ones keep their row with the higher confidence, new ones are added once."""
    rows = state.select("company", "url", "confidence", F.lit(0).alias("_new")).unionByName(found.select("company", "url", "confidence", F.lit(1).alias("_new")))
    return rows.groupBy("company", "url").agg(F.max("confidence").alias("confidence"), (F.min("_new") == 1).alias("created"))


def replace_by_key(state: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """`state` with the rows of a batch in place of those with their keys; of several rows of a key the latest counts."""
    rest = [c for c in state.columns if c not in keys]
    newest = latest(rows, keys, [F.col(at)], rest)
    return state.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(state.columns))


def rename_everywhere(rows: DataFrame, renamed: DataFrame, key: str, name: str) -> DataFrame:
    """Copies of a name follow a rename; `renamed` has the key once, and name."""
    new = renamed.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    return rows.join(new, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_name", name)).drop("_key", "_name")


def review_events(events: DataFrame, reviews: DataFrame, companies: DataFrame) -> DataFrame:
    """Events after reviews (event_id, action): accepting or ignoring settles all pending events of the company.

    Ignoring an event of a seed settles this event only. Of several reviews of a
    company ignoring wins. `events` has event_id, company_id, status.
    """
    asked = reviews.join(events.where("status = 'PENDING'").select("event_id", "company_id"), "event_id").join(companies.select("company_id", "is_seed"), "company_id")
    alone = asked.where("action = 'ignore' and is_seed").select("event_id").distinct().withColumn("_alone", F.lit(True))
    whole = asked.where("action = 'accept' or not is_seed").groupBy("company_id").agg(F.when(F.bool_or(F.col("action") == "ignore"), "IGNORED").otherwise("ACCEPTED").alias("_whole"))
    rows = events.join(alone, "event_id", "left").join(whole, "company_id", "left")
    status = F.when(F.col("status") != "PENDING", F.col("status")).when(F.col("_alone"), "IGNORED").otherwise(F.coalesce("_whole", "status"))
    return rows.withColumn("status", status).select(events.columns)


def redirect_sources(sources: DataFrame, moved: DataFrame) -> DataFrame:
    """Sources with those that moved (source_id, new_url) switched off and the new address added, unless it is known."""
    rows = sources.join(moved.groupBy("source_id").agg(F.min("new_url").alias("_url")), "source_id", "left")
    old = rows.withColumn("active", F.col("active") & F.col("_url").isNull())
    new = rows.where("_url is not null").join(sources.select(F.col("company").alias("_c"), F.col("url").alias("_u")), (F.col("company") == F.col("_c")) & (F.col("_url") == F.col("_u")), "left_anti")
    new = new.groupBy("company", F.col("_url").alias("url")).agg(F.concat(F.lit("redirect:"), F.min("source_id").cast("string")).alias("source_id")).withColumn("active", F.lit(True))
    return old.select(sources.columns).unionByName(new.select(sources.columns))


def due_for_scan(now: Column, interval_hours: float) -> Column:
    """Companies that aren't ignored, are known or seeds, and were never scanned or not within the interval."""
    known = F.col("status").isin("VERIFIED", "ACTIVE", "INACTIVE") | F.col("is_seed")
    old = F.col("last_scanned_at").isNull() | (dates.hours_between(F.col("last_scanned_at"), now) > interval_hours)
    return (F.col("review_status") != "IGNORED") & known & old


def scan_order() -> list[Column]:
    """S-tier companies first, then the longest unscanned, never scanned ones before all."""
    return [F.asc(F.when(F.col("tier") == "S", 0).otherwise(1)), F.asc_nulls_first("last_scanned_at"), F.desc("discovery_score"), F.asc("company_id")]


def expired(payload: Column, now: Column) -> Column:
    """Whether a listing's own payload says that it ended; false where it has no date."""
    end = F.coalesce(F.get_json_object(payload, "$.validThrough"), F.get_json_object(payload, "$.ExternalPostedEndDate"))
    return F.coalesce(dates.parse_posted(end)["value"] < now.cast("timestamp"), F.lit(False))


def stale_source(now: Column, scoped: list[str], interval_hours: float) -> Column:
    """Open listings of keyword-scoped sources not seen for three scan intervals, 72 hours at least."""
    age = dates.hours_between(F.col("last_seen_at"), now)
    return (F.col("listing_status") == "OPEN") & F.col("source").isin(*scoped) & (age.isNull() | (age > max(72.0, 3 * interval_hours)))


def reconcile(sources: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """Sources with a verdict: closed by their own end date or a failed check, verified by one that found them, else unchanged.

    `checks` has source_id and found (null: the page said nothing).
    """
    rows = sources.join(checks.groupBy("source_id").agg(F.bool_or("found").alias("_found"), F.lit(True).alias("_checked")), "source_id", "left")
    open_ = F.col("listing_status") == "OPEN"
    verdict = F.when(~open_, "unchanged").when(expired(F.col("raw_payload"), now) | ~F.col("_found"), "closed").when(F.col("_found"), "verified").when(F.col("_checked"), "unverifiable").otherwise("unchanged")
    return rows.withColumn("verdict", verdict).withColumn("listing_status", F.when(F.col("verdict") == "closed", "CLOSED").otherwise(F.col("listing_status"))).drop("_found", "_checked")
