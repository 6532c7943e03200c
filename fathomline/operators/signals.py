"""Hiring signals from search results and page titles, by an ordered table of rules.

The texts of a result that may name a company or a role become rows of
candidates, each judged once. What holds of a result is a set of features, and
the first rule whose features fit decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jobs, names, text
from .companies import domain_evidence, normal_name
from .ranked import checkpointed, once

#: Titles that say who hires for what, in the order in which they are tried; groups by `GROUPS`.
EXPLICIT = [
    r"(?i)^job application for (.+?) at (.+?)$",
    r"(?i)^(.+?) hiring (.+?) in (.+?)(?:\s*[|\-–—]\s*linkedin.*)?$",
    r"(?i)^(.+?) is hiring (?:an? )?(.+?)(?:\s*[|\-–—].*)?$",
    r"(?i)^([^|\-–—@]+?) (?:job )?(?:at|@) ([^|\-–—,]+?)(?:,? in [^|]+)?(?:\s*[|\-–—].*)?$",
]
GROUPS = [{"role": 1, "company": 2}, {"company": 1, "role": 2, "location": 3}, {"company": 1, "role": 2}, {"role": 1, "company": 2}]
#: A list of openings, posts that name a company, and words of a site itself.
LISTING = r"(?i)^\s*[\d,]+\+?\s+(.+?)\s+jobs?\s+in\s+(.+?)\s*(?:[-|–—]\s*linkedin.*)?$"
POSTS = [
    r"\b(?i:we(?:'re| are)|is)\s+(?i:hiring)\b[^.!?]{0,80}?\b(?i:at|@)\s+@?([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})",
    r"\b([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})\s+is\s+(?i:hiring)\b",
    r"\b(?i:join\s+(?:us|our\s+\w+(?:\s+\w+)?\s+team)\s+at)\s+@?([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,3})",
]
SITE_WORDS = r"(?i)^(?:careers?|jobs?|job details|apply|apply now|openings?|open positions|home|join us|we'?re hiring|hiring|full[- ]time|part[- ]time|contract|internship)$"
HIRING_URL = r"(?i)/(?:jobs?|careers?|positions?|openings?|vacanc|requisition|opportunit|o/|apply|job-details|jobdetails|hiring)|gh_jid=|jobid=|job_id="
HIRING_TEXT = r"(?i)\b(?:hiring|jobs?|careers?|apply|openings?|vacanc\w*|positions?|join our|we're looking|we are looking|recruit\w*)\b"
JOB_PAGE = r"(?i)/(?:job|jobs|o|positions?|requisitions?|job-details|jobdetails)/[^/?#]+|gh_jid=|jobid=|job_id=|/job-?details\b"
PARTS = r"\s+[|\-–—·•:]\s+|\s*\|\s*"
#: Texts that list a company's rivals, and how they are related.
SIMILAR = [
    (r"(?i)(?:top\s+)?(?:competitors|alternatives|rivals|similar\s+companies|peers)\s+(?:of|to|for)\s+[^:.]{0,60}?\s*(?:include|includes|are|:)\s+([^.]{5,300})", "competes_with"),
    (r"(?i)(?:competitors|alternatives|rivals|similar\s+companies|peers)\s+(?:include|includes|are|:)\s+([^.]{5,300})", "competes_with"),
    (r"(?i)\bcompet(?:es|ing)\s+with\s+([^.]{5,300})", "competes_with"),
    (r"(?i)\bcompanies\s+(?:similar\s+to|like)\s+[^,.]{2,60}?\s+(?:include|are|such as)\s+([^.]{5,300})", "similar_to"),
]


@dataclass(frozen=True)
class Rule:
    """Fires if all features of `needs` hold and none of `bars`. A rule without a company ends the search without a signal."""

    name: str
    needs: tuple[str, ...]
    bars: tuple[str, ...] = ()
    company: str | None = None
    role: str | None = None
    reason: str | None = None  # by the kind of page if None
    confidence: float | None = None


#: The rules in their order, with their confidence.
RULES = [
    Rule("post", ("post_site", "post_role", "post_company"), (), "post_company", "post_role", "X_HIRING_SIGNAL", 0.35),
    Rule("post without an employer", ("post_site",)),
    Rule("network page", ("network_site", "network_company", "network_role"), (), "network_company", "network_role", "LINKEDIN_HIRING_SIGNAL", 0.65),
    Rule("network listing", ("network_site", "listing_company", "listing_role"), ("network_title",), "listing_company", "listing_role", "LINKEDIN_HIRING_SIGNAL", 0.45),
    Rule("network page without an employer", ("network_site",)),
    Rule("no role", (), ("title_role", "snippet_role")),
    Rule("board, named in the title", ("board", "company", "job_page", "title_role"), (), "company", "role", "JOB_SEARCH", 0.8),
    Rule("board, named in the title of another page", ("board", "company"), (), "company", "role", "JOB_SEARCH", 0.6),
    Rule("board, named by its key", ("board", "board_company"), (), "board_company", "role", "JOB_SEARCH", 0.5),
    Rule("board without an employer", ("board",)),
    Rule("aggregator", ("aggregator", "company", "hiring"), (), "company", "role", "JOB_SEARCH", 0.5),
    Rule("aggregator without an employer", ("aggregator",)),
    Rule("no talk of hiring", (), ("hiring",)),
    Rule("own job page", ("company", "own_domain", "job_page", "title_role"), (), "company", "role", None, 0.8),
    Rule("own page", ("company", "own_domain"), (), "company", "role", None, 0.65),
    Rule("employer in the title", ("company",), (), "company", "role", None, 0.4),
    Rule("careers page of the domain", ("careers_page", "domain_company"), ("names_other",), "domain_company", "role", None, 0.45),
    Rule("no employer", ()),
]


def first_rule(held: Column, rules: list[Rule] = RULES) -> Column:
    """The first of the rules that fits an array of features, as a struct; null if none does."""
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    table = F.array(*(
        F.struct(
            F.lit(r.name).alias("name"), texts(r.needs).alias("needs"), texts(r.bars).alias("bars"), F.lit(r.company).cast("string").alias("company"),
            F.lit(r.role).cast("string").alias("role"), F.lit(r.reason).cast("string").alias("reason"), F.lit(r.confidence).cast("double").alias("confidence"),
        )
        for r in rules
    ))
    fits = lambda r: (F.size(F.array_except(r["needs"], held)) == 0) & ~F.arrays_overlap(r["bars"], held)
    return F.get(F.filter(table, fits), F.lit(0))


def _piece(kind: str, pos: Column | int, company: Column | None = None, role: Column | None = None, location: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    text_of = lambda c: null if c is None else F.nullif(F.trim(c), F.lit(""))
    return F.struct(F.lit(kind).alias("kind"), (F.lit(pos) if isinstance(pos, int) else pos).alias("pos"), text_of(company).alias("company"), text_of(role).alias("role"), text_of(location).alias("location"))


def _before(value: Column, phrase: Column) -> Column:
    return F.substring(value, F.lit(1), F.instr(value, phrase) - 1)


def _pieces(title: Column, snippet: Column, platform: Column, domain: Column) -> Column:
    """All texts of a result that may name a company or a role."""
    group = lambda pattern, k: F.regexp_extract(title, pattern, k)
    explicit = [F.when(title.rlike(p), _piece("explicit", i, *(group(p, g[n]) if n in g else None for n in ("company", "role", "location")))) for i, (p, g) in enumerate(zip(EXPLICIT, GROUPS, strict=True))]
    rest = F.regexp_extract(title, LISTING, 1)
    found = jobs.role_phrase(rest)
    listing = F.when(title.rlike(LISTING) & found.isNotNull(), _piece("listing", 0, _before(rest, found), found, F.regexp_extract(title, LISTING, 2)))
    split = lambda pattern: F.filter(F.transform(F.split(title, pattern), lambda x: F.trim(x)), lambda s: s != "")
    parts = split(PARTS)
    listed = (F.size(parts) == 1) & title.contains(",")  # a title without other marks is parted at its commas

    def segment(s: Column, i: Column) -> Column:
        of = lambda phrase: _piece("segment", i, F.when(phrase.isNotNull(), _before(s, phrase)).otherwise(s), F.coalesce(phrase, s))
        return F.get(F.transform(F.array(jobs.role_phrase(s)), of), F.lit(0))

    def part(s: Column, i: Column) -> Column:
        return _piece("part", i, None, s)

    both = F.concat_ws(". ", title, snippet)
    posts = [F.when(both.rlike(p), _piece("post", i, F.regexp_extract(both, p, 1))) for i, p in enumerate(POSTS)]
    key = F.trim(F.regexp_replace(platform["key"], "[-_]+", " "))
    one = [
        listing, *explicit, *posts,
        _piece("whole", 0, None, title), _piece("snippet", 0, None, jobs.role_phrase(snippet)), _piece("post_role", 0, None, jobs.role_phrase(both)),
        _piece("board", 0, F.when(F.lower(key) == key, F.initcap(key)).otherwise(key)),
        _piece("domain", 0, F.initcap(F.replace(F.split_part(domain, F.lit("."), F.lit(1)), F.lit("-"), F.lit(" ")))),
    ]
    return F.concat(F.array_compact(F.array(*one)), F.transform(F.when(listed, split(",")).otherwise(parts), segment), F.transform(parts, part))


def _pick(pieces: Column, kind: str, holds=lambda p: F.lit(True)) -> Column:
    """The first piece of a kind for which a condition holds."""
    return F.get(F.filter(pieces, lambda p: (p["kind"] == kind) & holds(p)), F.lit(0))


def signals(results: DataFrame, id_col: str, title: str, url: str, snippet: str, rules: list[Rule] = RULES) -> DataFrame:
    """One row for each result: the rule that fired, and the signal where it has one.

    Returns the id, rule, company, reason, confidence, role, relevance,
    location, domain, career_url and job_url; all but id and rule are null
    without a signal. `id_col` names a row. Null titles and snippets count as
    empty; a URL without a host gives the rule "no host". HTML entities of
    titles are decoded. Results are read once and kept, as they are parted into candidates and joined to them. Candidates are regrouped by id, so their rows are
    shuffled, and the texts of a result are not.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    rows = results.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.col(snippet).alias("snippet"), F.col(url).alias("url"))
    rows = once(rows, ["id", "url"], title=text.unescape(plain("title")), snippet=plain("snippet"))
    rows = rows.withColumn("host", text.host_name(F.col("url")))
    rows = checkpointed(rows.withColumns({"domain": text.registrable_domain(F.col("host")), "platform": jobs.platform_of(F.col("url"))}))
    pieces = rows.select("id", F.inline(_pieces(F.col("title"), F.col("snippet"), F.col("platform"), F.col("domain"))))
    null = F.lit(None).cast("string")
    pieces = pieces.withColumns({"found": jobs.role_phrase(F.col("role")).isNotNull(), "class": jobs.classify_role(F.col("role"), null, null), "name": names.candidate(F.col("company"), normal_name)})
    pieces = pieces.withColumns({"target": jobs.is_target(F.col("class.category"), F.col("class.relevance")), "relevance": F.col("class.relevance")})
    part = F.trim(F.regexp_replace(F.col("role"), "^[ ,.]+|[ ,.]+$", ""))
    other = (F.col("kind") == "part") & (part != "") & ~part.rlike(SITE_WORDS) & ~names.is_location(part) & ~(F.col("found") | F.col("class.category").isin(*jobs.TARGET_CATEGORIES))
    judged = pieces.select("id", F.struct("kind", "pos", "name", "role", "location", "found", "target", "relevance", F.coalesce(other, F.lit(False)).alias("other")).alias("p"))
    rows = rows.join(judged.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p")), "id")
    return _decide(rows, rules).withColumnRenamed("id", id_col)


def _decide(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    p = F.col("p")
    role_like = lambda x: x["found"] | x["target"]
    rows = rows.withColumns({"explicit": _pick(p, "explicit", lambda x: x["name"].isNotNull() & role_like(x)), "role_part": _pick(p, "segment", role_like)})
    # Segments before and after the one with the role name the company; in that one, what stands before the role.
    named = lambda x: x["name"].isNotNull() & (~x["found"] & (F.col("role_part.pos").isNull() | (x["pos"] != F.col("role_part.pos"))) | x["found"] & (x["pos"] == F.col("role_part.pos")))
    rows = rows.withColumns({"whole": _pick(p, "whole", lambda x: x["target"]), "name_part": _pick(p, "segment", named), "snippet_part": _pick(p, "snippet", lambda x: x["target"])})
    by_title = F.coalesce("explicit", "role_part", "whole")
    rows = rows.withColumns({"title_part": F.when(by_title["target"], by_title), "company": F.coalesce("explicit.name", "name_part.name")})
    rows = rows.withColumns({
        "role": F.coalesce("title_part", "snippet_part"),
        "network": _pick(p, "explicit", lambda x: x["pos"] == 1), "listing": _pick(p, "listing"), "post": _pick(p, "post", lambda x: x["name"].isNotNull()), "post_role": _pick(p, "post_role", lambda x: x["target"]),
        "board_part": _pick(p, "board"), "domain_part": _pick(p, "domain"),
    })
    url, domain = F.col("url"), F.col("domain")
    job_page = url.rlike(JOB_PAGE)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = F.when(~text.in_domains(domain, names.AGGREGATORS) & ~text.in_domains(domain, names.PLATFORMS), domain_evidence(F.col("company"), domain)).otherwise(0.0)
    features = {
        "post_site": domain.isin("x.com", "twitter.com"), "post_role": F.col("post_role").isNotNull(), "post_company": F.col("post").isNotNull(),
        "network_site": domain == "linkedin.com", "network_title": F.col("network").isNotNull(), "network_company": F.col("network.name").isNotNull(), "network_role": F.col("network.target"),
        "listing_company": F.col("listing.name").isNotNull(), "listing_role": F.col("listing.target"),
        "title_role": F.col("title_part").isNotNull(), "snippet_role": F.col("title_part").isNull() & F.col("snippet_part").isNotNull(),
        "board": F.col("platform.platform").isNotNull(), "company": F.col("company").isNotNull(), "board_company": F.col("board_part.name").isNotNull(), "job_page": job_page,
        "aggregator": text.in_domains(F.col("host"), names.AGGREGATORS), "hiring": url.rlike(HIRING_URL) | F.col("title").rlike(HIRING_TEXT), "own_domain": own >= 0.7,
        "careers_page": job_page | F.col("host").rlike(r"^(?:careers|jobs|career)\.") | path.rlike(r"(?i)/careers?(?:/|$)"), "domain_company": F.col("domain_part.name").isNotNull(), "names_other": F.exists(p, lambda x: x["other"]),
    }
    held = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in features.items())))
    rows = rows.withColumn("held", held).withColumn("r", F.when(F.coalesce(domain, F.lit("")) != "", first_rule(F.col("held"), rules)))
    company = {"company": F.col("company"), "post_company": F.col("post.name"), "network_company": F.col("network.name"), "listing_company": F.col("listing.name"), "board_company": F.col("board_part.name"), "domain_company": F.col("domain_part.name")}
    role = {"role": F.col("role"), "post_role": F.col("post_role"), "network_role": F.col("network"), "listing_role": F.col("listing")}
    chosen = lambda of, by: F.coalesce(*(F.when(by == n, c) for n, c in of.items()))
    rows = rows.withColumns({"by": chosen(company, F.col("r.company")), "as": chosen(role, F.col("r.role"))})
    signal = F.col("by").isNotNull()
    where = F.coalesce(F.when(F.col("r.role").isin("network_role", "listing_role"), F.col("as.location")), F.when(F.col("r.role") == "role", F.col("explicit.location")))
    on_page = F.col("r.reason").isNull() | F.col("board_part").isNotNull() & F.col("platform.platform").isNotNull()
    known_domain = F.col("r.name").isin("own job page", "own page", "careers page of the domain")
    return rows.select(
        "id", F.coalesce("r.name", F.lit("no host")).alias("rule"), F.col("by").alias("company"), F.when(signal, F.coalesce("r.reason", F.when(job_page, "JOB_SEARCH").otherwise("SEARCH_ENGINE"))).alias("reason"), "r.confidence",
        F.col("as.role").alias("role"), F.when(signal, F.col("as.relevance")).alias("relevance"), F.when(signal, where).alias("location"), F.when(known_domain, domain).alias("domain"),
        F.when(known_domain, careers_of(url)).alias("career_url"), F.when(signal & job_page & on_page, url).alias("job_url"),
    )


def careers_of(url: Column) -> Column:
    """Scheme and host of a URL, with its path as far as the first part that speaks of careers or ends in job or jobs."""
    root = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("://"), text.host_name(url), F.lit("/"))
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    at = F.array_position(F.transform(parts, lambda s: s.rlike(r"(?i)career|jobs?$")), True)
    return F.when(at > 0, F.concat(root, F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/"))).otherwise(root)


def similar_companies(results: DataFrame, id_col: str, company: str, title: str, snippet: str, most: int = 6) -> DataFrame:
    """Companies that a result lists beside the one asked for: id, name, relation, place (from 1), each key once and `most` at most.

    Patterns are tried in their order, each at all its places; the company
    itself is left out. `id_col` names a row. Nulls count as empty.
    """
    both = F.concat_ws(". ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(both, F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("list"), F.lit(kind).alias("relation")))
    lists = F.concat(*(found(*s) for s in SIMILAR))
    rows = results.select(F.col(id_col).alias("id"), F.replace(normal_name(F.coalesce(company, F.lit(""))), F.lit(" "), F.lit("")).alias("own"), F.posexplode(lists).alias("list", "l"))
    rows = rows.select("id", "own", "list", "l.relation", F.posexplode(F.split("l.list", r",\s*|\s+and\s+|;\s*|\s+&\s+")).alias("item", "raw"))
    rows = rows.withColumn("name", names.candidate(F.regexp_replace("raw", r"(?i)\b(?:etc|and more|among others|others|more)\b\.?", ""), normal_name)).where("name is not null")
    rows = rows.withColumn("key", F.replace(normal_name(F.col("name")), F.lit(" "), F.lit(""))).where("key <> own")
    first = rows.groupBy("id", "key").agg(F.min(F.struct("list", "item", "name", "relation")).alias("f"))
    listed = first.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("f")), 1, most).alias("f"))
    return listed.select(F.col("id").alias(id_col), F.posexplode("f").alias("place", "f")).select(id_col, "f.name", "f.relation", (F.col("place") + 1).alias("place"))
