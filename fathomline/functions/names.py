"""What may be a company's name, and what hosts and words belong to others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jobs, text

#: Hosts of job boards, networks and directories, which are no employer's.
AGGREGATORS = [
    "linkedin.com", "indeed.com", "naukri.com", "foundit.in", "monsterindia.com", "glassdoor.com", "glassdoor.co.in", "shine.com", "timesjobs.com", "instahyre.com", "cutshort.io", "hirist.tech", "hirist.com", "iimjobs.com", "wellfound.com", "angel.co", "simplyhired.com", "ziprecruiter.com", "dice.com", "builtin.com",
    "jooble.org", "talent.com", "careerjet.co.in", "adzuna.in", "apna.co", "internshala.com", "freshersworld.com", "bayt.com", "switchly.in", "jobspri.com", "myinternships.in", "prodmatchai.in", "analyticsinsight.net", "remotive.com", "remoteok.com", "weworkremotely.com", "himalayas.app", "ycombinator.com", "workatastartup.com",
    "x.com", "twitter.com", "facebook.com", "youtube.com", "reddit.com", "quora.com", "medium.com", "wikipedia.org", "github.com", "ambitionbox.com", "crunchbase.com", "tracxn.com", "owler.com", "zoominfo.com", "news.ycombinator.com", "levels.fyi", "teamblind.com", "jobsora.com", "jobrapido.com", "whatjobs.com", "learn4good.com",
    "duckduckgo.com", "bing.com", "economictimes.com", "indiatimes.com", "geeksforgeeks.org", "coursera.org", "udemy.com", "simplilearn.com", "edureka.co", "datacamp.com", "towardsdatascience.com", "naukri.in", "upwork.com", "fiverr.com", "freelancer.com", "toptal.com", "turing.com", "arc.dev", "instagram.com", "pinterest.com", "slideshare.net",
]
#: Hosts of applicant systems.
PLATFORMS = [
    "greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "myworkdaysite.com", "oraclecloud.com", "taleo.net", "smartrecruiters.com", "icims.com", "jobvite.com", "teamtailor.com", "recruitee.com", "workable.com", "bamboohr.com", "breezy.hr", "personio.de", "personio.com", "freshteam.com", "zohorecruit.com", "keka.com",
    "darwinbox.in", "successfactors.com", "successfactors.eu", "phenompeople.com", "eightfold.ai", "jazzhr.com", "applytojob.com", "rippling-ats.com", "pinpointhq.com",
]
#: Names of job boards.
BOARD_NAMES = [
    "linkedin", "indeed", "naukri", "naukri com", "glassdoor", "foundit", "monster", "monster india", "shine", "timesjobs", "instahyre", "cutshort", "hirist", "iimjobs", "wellfound", "angellist", "simplyhired", "ziprecruiter", "dice", "builtin", "built in", "jooble", "talent", "careerjet", "adzuna", "apna", "internshala",
    "freshersworld", "bayt", "switchly", "jobspri", "remotive", "remote ok", "remoteok", "we work remotely", "himalayas", "work at a startup", "y combinator", "ycombinator", "hacker news", "x", "twitter", "google jobs", "prodmatch", "myinternships", "ambitionbox", "levels fyi",
]
#: Words that stand where a name should and are none.
GENERIC_NAMES = [
    "data", "jobs", "job", "careers", "career", "hiring", "india", "remote", "engineering", "engineer", "engineers", "software", "technology", "technologies", "tech", "home", "search", "apply", "application", "job application", "job details", "openings", "vacancies", "opportunities", "company", "companies", "work", "team", "teams",
    "join us", "about", "about us", "login", "sign in", "stealth", "stealth startup", "stealth mode startup", "confidential", "our client", "client", "leading mnc", "mnc", "top mnc", "it company", "startup", "unknown", "n a", "na", "various", "multiple", "recruiter", "staffing", "consultancy", "hr", "full time", "part time", "contract",
    "senior", "lead", "staff", "principal", "platform", "infrastructure", "big data", "new", "latest", "today", "now", "we", "us", "our", "the", "a", "an", "logo", "welcome", "results", "search results", "home page", "homepage", "overview", "page", "site", "portal", "official site", "official website", "careers site", "career site",
    "job search", "job board", "employer", "hiring now", "open roles", "open positions",
]
#: Places and words of place.
LOCATION_WORDS = [
    "india", "remote", "bengaluru", "bangalore", "mumbai", "pune", "hyderabad", "chennai", "gurgaon", "gurugram", "noida", "delhi", "new delhi", "ncr", "delhi ncr", "kolkata", "ahmedabad", "jaipur", "kochi", "trivandrum", "thiruvananthapuram", "indore", "chandigarh", "coimbatore", "mysore", "mysuru", "vadodara", "nagpur",
    "bhubaneswar", "visakhapatnam", "karnataka", "maharashtra", "telangana", "tamil nadu", "haryana", "uttar pradesh", "west bengal", "kerala", "gujarat", "remote india", "anywhere", "worldwide", "united states", "usa", "us", "uk", "united kingdom", "singapore", "london", "new york", "san francisco", "seattle", "europe",
    "apac", "emea", "hybrid", "onsite", "on site", "work from home", "wfh", "global", "asia",
]
INDIA = r"(?i)\b(india|bengaluru|bangalore|mumbai|pune|hyderabad|chennai|gurgaon|gurugram|noida|new delhi|delhi|kolkata|ahmedabad|jaipur|kochi|thiruvananthapuram|trivandrum|indore|chandigarh|coimbatore|mysuru|mysore|vadodara|nagpur|bhubaneswar|visakhapatnam|karnataka|maharashtra|telangana|tamil nadu|haryana)\b"
#: Words of role titles; words that no name starts or ends with.
ROLE_WORDS = ["data", "platform", "infrastructure", "distributed", "systems", "system", "engineering", "engineer", "software", "backend", "senior", "staff", "lead", "principal", "analytics", "cloud", "devops", "big", "team", "remote", "hybrid", "onsite", "full", "time", "ii", "iii", "sr", "jr", "junior", "associate", "manager", "science", "scientist", "etl"]
FIRST_WORDS = ["what", "how", "why", "who", "when", "where", "which", "does", "do", "is", "are", "top", "best", "latest", "find", "search", "apply", "get", "hire", "become", "your", "my", "our", "all", "browse", "view", "explore"]
LAST_WORDS = ["a", "an", "the", "of", "for", "to", "at", "in", "and", "or", "with", "does", "do", "is", "are", "as", "by", "on"]
DESCRIPTIONS = ["startup", "startups", "companies", "firm", "client", "organization", "organisation", "agency", "employer", "unicorn", "mnc"]
#: What stands before and after a name on careers pages.
BEFORE_NAME = r"(?i)^(?:careers?\s+at|jobs?\s+at|working\s+at|work\s+at|join|life\s+at|job\s+openings?\s+at|open\s+positions?\s+at)\s+"
AFTER_NAME = r"(?i)(?:\s+|^)(?:careers?(?:\s+site|\s+page)?|jobs?(?:\s+board)?|hiring|recruitment|talent)$"


def _words(value: Column) -> Column:
    return F.filter(F.split(value, " +"), lambda w: w != "")


def stripped(value: Column, patterns: list[str], most: int = 2) -> Column:
    """What is left when all patterns have been taken away, one after another, up to `most` times.

    A round that changes nothing makes no further one differ, so a large `most` strips until nothing changes.
    """

    def once(now: Column, _: Column) -> Column:
        for pattern in patterns:
            now = F.regexp_replace(now, pattern, "")
        return now

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), value, once)


def is_location(value: Column) -> Column:
    """Whether a text is nothing but places: as a whole, or each of its parts."""
    plain = lambda v: F.trim(F.regexp_replace(F.lower(v), "[^a-z ]+", " "))
    parts = F.filter(F.transform(F.split(F.lower(value), "[,/]| or | and "), lambda x: F.trim(x)), lambda p: p != "")
    each = F.forall(parts, lambda p: plain(p).isin(*LOCATION_WORDS) | p.rlike(INDIA))
    return F.coalesce((plain(value) != "") & (plain(value).isin(*LOCATION_WORDS) | ((F.size(parts) > 0) & each)), F.lit(False))


def candidate(raw: Column, normal_name) -> Column:
    """A company's name as it may be shown, or null where the text can't be one.

    `normal_name` makes the form that names are compared in. Null and empty texts give null.
    """
    value = F.regexp_replace(raw, "^[ \"'“”‘’]+|[ \"'“”‘’]+$", "")
    value = F.trim(F.regexp_replace(value, r"https?://\S+|\bwww\.\S+", " "))
    host = value.rlike(r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+){2,}$") | (value.contains(".") & ~value.contains(" ") & (text.in_domains(F.lower(value), AGGREGATORS) | text.in_domains(F.lower(value), PLATFORMS)))
    short = stripped(F.regexp_replace(value, BEFORE_NAME, ""), [AFTER_NAME, r"^[ ,.|:\-]+|[ ,.|:\-]+$"])
    short = F.trim(F.regexp_replace(short, r"\s*\((?![^)]*\bYC\b)[^)]*\)\s*$", ""))

    def judged(v: Column) -> Column:
        normal = normal_name(v)
        words = _words(F.regexp_replace(F.lower(v), "[^a-z0-9 ]+", " "))
        ends = _words(normal)
        named = text.plausible_name(normal) & (F.char_length(v) <= 80) & ~normal.isin(*GENERIC_NAMES, *BOARD_NAMES, *LOCATION_WORDS) & ~is_location(v)
        vocabulary = (F.size(words) > 0) & (F.size(F.array_except(words, F.array(*(F.lit(w) for w in ROLE_WORDS)))) == 0)
        talk = F.coalesce(F.get(ends, F.lit(0)).isin(*FIRST_WORDS) | F.get(ends, F.size(ends) - 1).isin(*LAST_WORDS, *DESCRIPTIONS), F.lit(False))
        role = jobs.role_phrase(v).isNotNull() | jobs.classify_role(v, F.lit(None).cast("string"), F.lit(None).cast("string"))["category"].isin(*jobs.TARGET_CATEGORIES)
        return F.when((v != "") & named & ~vocabulary & ~talk & ~role, text.display_name(v))

    return F.when(~host, F.get(F.transform(F.array(short), judged), F.lit(0)))
