"""What postings ask for: items under headings, their kinds and modes, and the weights of skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jobs
from ..functions.names import INDIA
from .ranked import carried, numbered, once, spread, top
from .terms import find_terms, term_names

#: What makes an item preferred or required, and how requirements and duties begin.
PREFERRED = r"(?i)\b(?:preferred|nice[- ]to[- ]have|bonus|a plus|is a plus|are a plus|plus|good[- ]to[- ]have|desirable|ideally|advantageous|beneficial|would be great)\b"
REQUIRED = r"(?i)\b(?:required|must|minimum|at least|essential|mandatory|proven|strong (?:experience|knowledge|proficiency)|\d+\+?\s*(?:years?|yrs))\b"
ASKS = r"(?i)\b(?:experience|knowledge|proficien|skills?|familiar)"
REQUIREMENT_START = r"(?i)^(?:have|has|possess(?:es)?|bring|be (?:familiar|proficient|skilled|comfortable|experienced|able|an? (?:strong|excellent|proven))|experience (?:with|in|of|building|developing|designing)|\d+\+?\s*(?:years?|yrs)|strong|solid|deep|proven|hands[- ]on|proficien\w*|knowledge of|familiarity with|understanding of|expertise (?:in|with)|working knowledge|demonstrated|excellent|bachelor\w*|master\w*|degree)\b"
DUTY_START = (
    r"(?i)^(?:design|develop|build|create|implement|maintain|own|lead|drive|partner|collaborate|work|monitor|troubleshoot|optimi[sz]e|improve|support|contribute|participate|deliver|manage|architect|write|automate|deploy|operate|mentor|define|ensure|identify|analy[sz]e|"
    r"evaluate|integrate|migrate|scale|model|help|establish|enable|translate|review|document|champion|continuously)(?:s|es|d|ed|ing)?\b"
)
ANY = r"(?i)\b(?:such as|e\.g\.?|eg\.|like|including|or|any of|one or more|at least one|similar|equivalent|and/or|for example)\b"
#: Prefix of a requirement's number and its importance, by kind.
KINDS = {"required": ("R", 1.0), "responsibility": ("D", 0.7), "preferred": ("P", 0.5), "context": ("C", 0.3)}
WEAK = ["Data ingestion", "API development", "Stakeholder collaboration"]
#: Headings of sections, in the order in which they are tried.
HEADINGS = [
    (
        "preferred",
        r"(?:preferred|desired|bonus|additional|nice[- ]to[- ]have|good[- ]to[- ]have)(?: qualifications| skills| experience| points)?(?: \(?optional\)?)?|nice to haves?|pluses|bonus points|extra credit|it would be (?:great|nice) if(?: you)?(?: have)?|what would make you stand out|ways? to stand out",
    ),
    (
        "required",
        r"(?:basic|minimum|required|key|essential|mandatory)(?: qualifications| skills| requirements| experience)?|requirements|qualifications|what you(?:'|’)?ll need|what you need|what we(?:'|’)?re looking for|what we are looking for|you (?:have|bring|might be a fit if you|will need|should have)|must[- ]haves?|who you are|(?:all )?about you"
        r"|your (?:profile|background|skills|experience)|skills (?:and|&) (?:experience|qualifications)|professional (?:&|and) technical skills|what you(?:'|’)?ll bring|what you bring|technical skills|skills|experience(?: required)?|skills required|what (?:we|you) need(?: from you)?|you are"
        r"|(?:the )?ideal candidate(?: for this (?:position|role))?(?: (?:should|will|would|must))?(?: (?:have|be))?",
    ),
    (
        "responsibility",
        r"(?:key )?(?:job )?responsibilities|what you(?:'|’)?ll do|what you will do|(?:the |your |about the )?role|the position|in this (?:role|position)(?:,? you will)?|day[- ]to[- ]day|your impact|what you will be doing|roles? (?:&|and) responsibilities|job description|duties|the opportunity|what you(?:'|’)?ll be doing|the job|you will|your responsibilities|your mission",
    ),
    ("context", r"about (?:us|the team|the company|the business|[a-z0-9&.' -]{2,40})|who we are|our team|the team|our mission|why join(?: us)?|company overview|team overview|about this team"),
    (
        "ignore",
        r"benefits|perks|what we offer|equal (?:employment )?opportunity|eeo|compensation(?: and benefits)?|salary(?: range)?|pay (?:range|transparency)|accommodations?|privacy notice|disclaimer|additional information|our commitment|diversity(?:,? equity)?(?:,? (?:and|&) inclusion)?|life at [a-z0-9 ]+|(?:corporate )?security responsibility",
    ),
    ("intro", r"overview|summary|title and summary|our purpose|purpose|description|details|(?:job|position|role) (?:summary|overview|details)"),
]
#: Letters that a heading may have; in texts, how far talk of hybrid work is looked for; and places of a posting.
HEADING_LETTERS, HYBRID_LETTERS, PLACES = 70, 4000, 12
#: Terms that tell a role's focus.
DATA_FOCUS = ["Apache Spark", "Apache Kafka", "Airflow", "Azure Data Factory", "Azure Data Lake Storage", "Databricks"]
PLATFORM_FOCUS = ["Kubernetes", "Terraform", "Infrastructure as code", "CI/CD & DevOps", "Containers & orchestration", "Observability & monitoring"]
ANALYST = r"(?i)\b(dashboards?|tableau|power ?bi|looker|kpis?|business insights|statistical analysis|reporting|visuali[sz]ation)\b"
HYBRID, ONSITE, RELOCATION, SPONSOR = r"(?i)\bhybrid\b", r"(?i)\bon[- ]?site\b|\bin[- ]office\b", r"(?i)\brelocat(?:e|ion)\b", r"(?i)\b(?:visa )?sponsorship\b|\bsponsor\b"
#: Places that tell a country.
COUNTRIES = {
    "India": r"india|bengaluru|bangalore|hyderabad|pune|mumbai|chennai|gurgaon|gurugram|noida|delhi|kolkata",
    "United States": r"united states|usa|seattle|san francisco|new york|austin|boston|chicago",
    "United Kingdom": r"united kingdom|uk|london|manchester|edinburgh",
    "Ireland": r"ireland|dublin",
    "Canada": r"canada|toronto|vancouver|montreal",
    "Germany": r"germany|berlin|munich",
    "Singapore": r"singapore",
    "Japan": r"japan|tokyo",
    "France": r"france|paris",
    "Spain": r"spain|madrid|barcelona",
}


def heading_kind(line: Column) -> Column:
    """The kind of section that a line opens; null for a line that is no heading: a long one, a bullet or a sentence."""
    bare = F.trim(line)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(HEADINGS):
        out = F.when(F.regexp_replace(bare, ":+$", "").rlike(rf"(?i)^\W*(?:{pattern})\W*$"), kind).otherwise(out)
    return F.when((bare != "") & (F.char_length(bare) <= HEADING_LETTERS) & ~bare.rlike(r"^[-•*●◦]|[.!?]$"), out)


def item_kind(section: Column, item: Column) -> Column:
    """required, preferred, responsibility or context, by the section and the item's own words."""
    own = (
        F.when(item.rlike(PREFERRED), "preferred")
        .when(item.rlike(REQUIRED) & item.rlike(ASKS), "required")
        .when((section == "intro") & item.rlike(REQUIREMENT_START), "required")
        .when((section == "intro") & item.rlike(DUTY_START), "responsibility")
        .otherwise("context")
    )
    softer = (section == "required") & item.rlike(PREFERRED) & ~item.rlike(REQUIRED)
    return F.when(section.isin("intro", "context"), own).when(softer, "preferred").otherwise(section)


def requirement_mode(item: Column, terms: Column) -> Column:
    """any where alternatives are named or joined by a slash, else all; a single term is always all."""
    slash = item.rlike(r"[A-Za-z0-9+#.)]\s*/\s*[A-Za-z0-9]")
    return F.when(F.size(terms) <= 1, "all").when(item.rlike(ANY) | slash, "any").otherwise("all")


def location_requirements(location: Column, status: Column, text: Column, hybrid_letters: int = HYBRID_LETTERS, most: int = PLACES) -> Column:
    """struct(mode, places, countries, india, remote_regions, relocation_offered, visa_sponsorship_mentioned) of a posting.

    Talk of hybrid work counts in the first `hybrid_letters` letters of the text
    alone, as further on it mostly isn't about the posting, and `most` places are
    listed; countries and remote regions are those of all places. A place in India
    counts for no other country. A remote place without a region is "unspecified".
    """
    places = F.filter(F.transform(F.split(F.coalesce(location, F.lit("")), r";|\|| / "), lambda p: F.trim(p)), lambda p: p != "")
    in_india = lambda p: p.rlike(INDIA)
    found = F.transform(places, lambda p: F.when(in_india(p), F.array(F.lit("India"))).otherwise(F.array_compact(F.array(*(F.when(p.rlike(rf"(?i)\b(?:{w})\b"), F.lit(c)) for c, w in COUNTRIES.items())))))
    body = F.coalesce(text, F.lit(""))
    region = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?i)\bremote\b|[-,()]", " "), r"\s+", " "))
    regions = F.transform(F.filter(places, lambda p: p.rlike(r"(?i)\bremote\b")), lambda p: F.coalesce(F.nullif(region(p), F.lit("")), F.lit("unspecified")))
    remote = (status == "remote") | (F.size(regions) > 0)
    mode = F.when(remote, "remote").when((status == "hybrid") | F.substring(body, 1, hybrid_letters).rlike(HYBRID), "hybrid").when((status == "onsite") | body.rlike(ONSITE), "onsite").otherwise("unknown")
    first = F.get(F.filter(F.split(body, r"(?<=[.!?])\s+"), lambda s: s.rlike(RELOCATION)), F.lit(0))
    return F.struct(
        mode.alias("mode"), F.slice(places, 1, most).alias("places"), F.array_distinct(F.flatten(found)).alias("countries"), F.exists(places, in_india).alias("india"), regions.alias("remote_regions"),
        (~first.rlike(r"(?i)\b(?:no|not)\b")).alias("relocation_offered"), body.rlike(SPONSOR).alias("visa_sponsorship_mentioned"),
    )


def role_focus(names: Column, text: Column) -> Column:
    """analytics, platform, data_engineering or software, by the terms of a posting and its analysts' words."""
    some = lambda wanted: F.size(F.array_intersect(names, F.array(*(F.lit(n) for n in wanted))))
    analyst = F.size(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANALYST), F.lit(1)), F.lower)))
    data, platform = some(DATA_FOCUS), some(PLATFORM_FOCUS)
    return F.when((analyst >= 3) & (data < 3), "analytics").when((platform >= 3) & (platform > data), "platform").when(data > 0, "data_engineering").otherwise("software")


def section_items(postings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, section, item): the lines of a posting under their headings; repeated items count once.

    Lines before any heading belong to the intro, and ignored sections are left out.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    lines = postings.select(key, F.posexplode(parts).alias("pos", "line"))
    lines = once(lines, [key, "pos"], _heading=heading_kind(F.col("line")), line=F.trim(F.regexp_replace("line", r"^[\s•·*\-–]+", ""))).where("line <> ''")
    lines = spread(lines, postings.agg(F.sum(F.size(parts))).first()[0] or 0, key)
    rows = carried(lines, [key], ["pos"], F.col("_heading"), "section").where("_heading is null")
    rows = rows.select(key, "pos", F.coalesce("section", F.lit("intro")).alias("section"), F.col("line").alias("item")).where("section <> 'ignore'")
    return top(rows.withColumn("_low", F.lower("item")), [key, "_low"], [F.asc("pos")]).drop("_low")


def requirements(items: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """(key, pos, requirement_id, kind, item, terms, mode, years, importance) of the items that ask for something.

    Items without a term and without years are dropped, and so is mere context without a term.
    """
    rows = once(items, items.columns, kind=item_kind(F.col("section"), F.col("item")), terms=term_names(find_terms(F.col("item"), patterns)), years=jobs.years_required(F.col("item"))["low"])
    rows = rows.where((F.size("terms") > 0) | (F.col("years").isNotNull() & (F.col("kind") != "context")))
    prefix, importance = (F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[i])) for k, v in KINDS.items())) for i in (0, 1))
    strong = F.filter("terms", lambda t: ~t.isin(*WEAK))
    rows = rows.withColumns({"mode": requirement_mode(F.col("item"), strong), "importance": importance})
    return numbered(rows, [key, "kind"], [F.asc("pos")], prefix, "requirement_id").select(key, "pos", "requirement_id", "kind", "item", "terms", "mode", "years", "importance")


def skill_weights(asked: DataFrame, key: str) -> DataFrame:
    """Per posting and term its summed importance, weak ones at 0.6, whether it is required, and its requirements."""
    rows = asked.select(key, "kind", "requirement_id", "pos", "importance", F.explode("terms").alias("term"))
    weight = F.col("importance") * F.when(F.col("term").isin(*WEAK), 0.6).otherwise(1.0)
    out = rows.groupBy(key, "term").agg(F.round(F.sum(weight.cast("decimal(10,3)")), 2).cast("double").alias("weight"), F.bool_or(F.col("kind").isin("required", "responsibility")).alias("required"), F.array_sort(F.collect_set("requirement_id")).alias("requirement_ids"))
    return out


def analyze_postings(postings: DataFrame, key: str, title: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Per posting what its analysis says: skills with weights, years, seniority, focus, and the number of requirements.

    Every posting has a row; without requirements its skills are empty and its years null.
    """
    asked = requirements(section_items(postings, key, text), key, patterns)
    skills = skill_weights(asked, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), F.col("term").alias("name"), "weight", "required", "requirement_ids"))).alias("_skills"))
    years = asked.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("kind") == "required", F.col("years"))), F.max("years")).alias("_years"), F.count("*").alias("n_requirements"))
    rows = postings.join(skills, key, "left").join(years, key, "left")
    named = jobs.years_required(F.coalesce(F.col(title), F.lit("")))
    years_min = F.coalesce(named["low"], F.col("_years"))
    names = F.transform(F.coalesce("_skills", F.array().cast(skills.schema["_skills"].dataType)), lambda s: s["name"])
    return rows.select(
        key,
        F.transform("_skills", lambda s: s.dropFields("order")).alias("skills"),
        years_min.alias("years_min"),
        jobs.seniority(F.col(title), years_min).alias("seniority"),
        role_focus(names, F.col(text)).alias("role_focus"),
        F.coalesce("n_requirements", F.lit(0).cast("long")).alias("n_requirements"),
    )
