"""What titles, locations and descriptions of postings say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Technologies and their names in normalised text.
TECHNOLOGIES = {
    "Azure Data Lake Storage": ["azure data lake", "adls", "adls gen2"],
    "Apache Spark": ["apache spark", "pyspark", "spark"],
    "Apache Kafka": ["apache kafka", "kafka"],
    "Azure Data Factory": ["azure data factory", "adf"],
    "Databricks": ["azure databricks", "databricks"],
    "Airflow": ["apache airflow", "airflow"],
    "Python": ["python"],
    "SQL": ["sql"],
    "PostgreSQL": ["postgresql", "postgres"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Terraform": ["terraform"],
}

#: Title patterns with relevance; the best of a family counts.
DATA_TITLES = [
    (r"\bdata\s+engineer(?:ing)?\b", 0.95),
    (r"\bbig\s+data\b", 0.9),
    (r"\bdata\s+platform\b", 0.95),
    (r"\bdata\s+infra(?:structure)?\b", 0.95),
    (r"\bdata\s+systems?\s+(?:engineer|developer)", 0.9),
    (r"\b(?:etl|elt)\b", 0.8),
    (r"\bdata\s+pipelines?\b", 0.85),
    (r"\bdata\s+(?:warehouse|warehousing|lake|lakehouse)\b", 0.8),
    (r"\bstreaming\s+(?:data\s+)?(?:engineer|platform)", 0.8),
    (r"\b(?:software|backend|back-end)\s+(?:development\s+)?engineer\b.{0,40}\bdata\b", 0.85),
    (r"\bdata\b.{0,25}\b(?:software|backend)\s+engineer\b", 0.8),
]
PLATFORM_TITLES = [
    (r"\bdistributed\s+systems?\b", 0.9),
    (r"\bplatform\s+engineer", 0.75),
    (r"\binfra(?:structure)?\s+(?:software\s+)?engineer", 0.75),
    (r"\b(?:software|backend)\s+engineer\b.{0,40}\b(?:infra(?:structure)?|platform)\b", 0.8),
    (r"\bsite\s+reliability\b|\bsre\b", 0.45),
    (r"\bcloud\s+(?:platform\s+|infrastructure\s+)?engineer", 0.45),
    (r"\bdevops\b", 0.45),
    (r"\bdatabase\s+(?:engineer|reliability|administrator)", 0.5),
]
ADJACENT_TITLES = [
    (r"\bdata\s+analy(?:st|tics)\b", 0.15),
    (r"\b(?:product|marketing|business|growth)\s+analy(?:st|tics)\b", 0.15),
    (r"\bbusiness\s+(?:intelligence|analyst)\b|\bbi\s+(?:developer|analyst|engineer)\b", 0.2),
    (r"\banalytics\s+engineer", 0.55),
    (r"\bdata\s+scien(?:ce|tist)\b", 0.3),
    (r"\b(?:ml|machine\s+learning|ai)\s+engineer", 0.35),
    (r"\bdata\s+(?:governance|quality\s+analyst|steward|privacy|protection)\b", 0.25),
]
HARD_TITLES = [
    (r"\bdata\s+cent(?:er|re)s?\b", 0.05),
    (r"\bdata\s+entry\b", 0.02),
    (r"\b(?:mechanical|electrical|civil|chemical|hardware|asic|fpga|rf|analog|layout|silicon)\s+(?:product\s+)?(?:design\s+)?engineer", 0.05),
]
EXCLUDED = r"\b(sales|account\s+(?:executive|manager)|recruit(?:er|ing)|talent\s+acquisition|marketing|copywriter|designer|counsel|attorney|lawyer|accountant|nurse|physician|driver|technician|mechanic|electrician|warehouse\s+associate|customer\s+(?:success|support)|support\s+specialist|pre-?sales|solutions?\s+consultant|product\s+(?:delivery\s+)?manager|product\s+owner|program\s+manager|project\s+manager|delivery\s+manager|scrum\s+master|business\s+analyst)\b"
ENTERPRISE = r"\b(salesforce|servicenow|sap|dynamics\s*365|oracle\s+(?:apex|ebs|fusion)|workday\s+hcm|guidewire|pega|power\s*(?:platform|apps|automate)|sharepoint)\b"
SPECIALTIES = r"\b(security|cyber\s*security|network(?:ing)?|embedded|firmware|robotics?|autonomous|graphics|gpu|kernel|compilers?|mobile|android|ios|front[-\s]?end|ui|ux|games?|gaming|audio|video|camera|perception|computer\s+vision|wireless|5g|telecom|voice|desktop|end[-\s]?user|endpoint|citrix|vmware|mainframe|cobol|qa|sdet|test|testing|verification|validation)\b"
MASTER_DATA = r"\bmaster\s+data\b|\bsap\b"
GENERIC = r"\b(?:software|backend|back-end|full[\s-]?stack|java|python|scala|golang|go)\s+(?:engineer|developer)\b|\bsde\b|\bswe\b|\bmember of technical staff\b"
ENGINEERING = r"\b(engineer|developer|architect|programmer)\b"
SIGNALS = {
    "Spark": r"\bpy?spark\b",
    "Kafka": r"\bkafka\b",
    "Airflow": r"\bairflow\b",
    "dbt": r"\bdbt\b",
    "Flink": r"\bflink\b",
    "Beam": r"\bapache\s+beam\b",
    "Databricks": r"\bdatabricks\b",
    "Snowflake": r"\bsnowflake\b",
    "BigQuery": r"\bbigquery\b",
    "Redshift": r"\bredshift\b",
    "Hadoop": r"\bhadoop\b|\bhdfs\b",
    "Hive": r"\bhive\b",
    "Presto/Trino": r"\bpresto\b|\btrino\b",
    "table formats": r"\biceberg\b|\bdelta\s+lake\b|\bhudi\b",
    "ETL/ELT": r"\betl\b|\belt\b",
    "data pipelines": r"\bdata\s+pipelines?\b",
    "data lake": r"\bdata\s+lakes?\b|\blakehouse\b",
    "data warehouse": r"\bdata\s+warehous(?:e|es|ing)\b",
    "data modeling": r"\bdata\s+model(?:l)?ing\b",
    "streaming": r"\bstream(?:ing)?\s+(?:data|processing)\b|\breal[-\s]time\s+data\b",
    "batch processing": r"\bbatch\s+processing\b",
    "CDC": r"\bchange\s+data\s+capture\b|\bcdc\b",
    "columnar formats": r"\bparquet\b|\bavro\b",
    "cloud data services": r"\b(?:aws\s+glue|emr|dataflow|dataproc|synapse|data\s+factory|kinesis)\b",
    "data ingestion": r"\bdata\s+ingestion\b",
    "data platform": r"\bdata\s+(?:platform|infrastructure)\b",
    "large-scale data": r"\b(?:petabyte|terabyte)s?\b",
}
#: Letters without which a text can have no match of a pattern, where they aren't the label's own in lower case. Looking for them costs far less than the pattern.
NEEDLES = {
    "Beam": ["beam"],
    "Hadoop": ["hadoop", "hdfs"],
    "Presto/Trino": ["presto", "trino"],
    "table formats": ["iceberg", "delta", "hudi"],
    "ETL/ELT": ["etl", "elt"],
    "data pipelines": ["pipeline"],
    "data lake": ["lake"],
    "data warehouse": ["warehous"],
    "data modeling": ["model"],
    "streaming": ["stream", "real"],
    "batch processing": ["batch"],
    "CDC": ["capture", "cdc"],
    "columnar formats": ["parquet", "avro"],
    "cloud data services": ["glue", "emr", "dataflow", "dataproc", "synapse", "factory", "kinesis"],
    "data ingestion": ["ingestion"],
    "data platform": ["platform", "infrastructure"],
    "large-scale data": ["petabyte", "terabyte"],
    "Kubernetes": ["kubernetes", "k8s"],
    "infrastructure as code": ["terraform", "infrastructure"],
    "distributed systems": ["distributed"],
    "microservices": ["microservice"],
    "service mesh": ["mesh"],
    "fault tolerance": ["availability", "toleran"],
    "consensus": ["consensus", "raft", "paxos"],
}
CORE_SIGNALS = ["Spark", "Kafka", "Airflow", "dbt", "Flink", "Beam", "ETL/ELT", "data pipelines", "data lake", "data warehouse", "streaming", "CDC", "data ingestion", "data platform"]
PLATFORM_SIGNALS = {
    "Kubernetes": r"\bkubernetes\b|\bk8s\b",
    "infrastructure as code": r"\bterraform\b|\binfrastructure\s+as\s+code\b",
    "distributed systems": r"\bdistributed\s+systems?\b",
    "microservices": r"\bmicroservices?\b",
    "observability": r"\bobservability\b",
    "service mesh": r"\bservice\s+mesh\b",
    "fault tolerance": r"\bhigh\s+availability\b|\bfault[-\s]toleran",
    "consensus": r"\bconsensus\b|\braft\b|\bpaxos\b",
}
ANALYST_WORDS = r"\b(dashboards?|tableau|power\s*bi|looker|excel|reporting|kpis?|stakeholders?|insights|a/b\s+test\w*|visuali[sz]ations?|storytelling|ad[-\s]hoc\s+analysis)\b"
HARDWARE_WORDS = r"\b(interconnect|cables?|pcb|silicon|asic|racks?|cooling|hvac|electrical|mechanical|manufacturing|bill of materials|bom|plm|firmware|power\s+distribution|facilit(?:y|ies))\b"
TARGET_CATEGORIES = ("data_engineering", "platform_infrastructure")
#: Relevance of a target, letters from which a description may speak of something else than its title, what ends a title's first part.
TARGET_FROM = 0.5
OFF_TOPIC_FROM = 150
FIRST_PART = r"\s*[,|(]\s*|\s+[-–—:]\s+"

#: Levels in titles, the first that fits.
LEVELS = [
    ("intern", r"\b(intern(?:ship)?|trainee|apprentice)\b"),
    ("executive", r"\b(director|head of|vice president|svp|evp|vp\b|chief|cto|cdo)\b"),
    ("manager", r"\bmanager\b"),
    ("principal", r"\b(principal|distinguished|fellow)\b"),
    ("staff", r"\b(staff|lead|architect)\b"),
    ("senior", r"\b(senior|sr\.?|iii\b|level\s*3)\b"),
    ("mid", r"\b(ii\b|level\s*2|mid[- ]level)\b"),
    ("junior", r"\b(junior|jr\.?|associate|entry[- ]level|graduate|new grad|i\b)\b"),
]

#: Factors of units in pay ranges.
UNITS = {"k": 1e3, "lpa": 1e5, "lakh": 1e5, "lakhs": 1e5, "l": 1e5, "cr": 1e7, "m": 1e6}
CURRENCIES = {"$": "USD", "₹": "INR", "£": "GBP", "€": "EUR", "RS": "INR", "RS.": "INR"}


def remote_status(*texts: Column) -> Column:
    """remote before hybrid before onsite, else unknown; null texts are passed over."""
    text = F.lower(F.concat_ws(" ", *texts))
    return (
        F.when(text.rlike(r"\b(?:remote|work from home|wfh|anywhere|telecommute)\b"), "remote")
        .when(text.rlike(r"\bhybrid\b"), "hybrid")
        .when(text.rlike(r"\b(?:on-?site|in[- ]office)\b"), "onsite")
        .otherwise("unknown")
    )


def technologies(normalized: Column) -> Column:
    """Names of TECHNOLOGIES in a normalised text, in their order."""
    found = [F.when(normalized.rlike(r"\b(?:" + "|".join(names) + r")\b"), F.lit(tech)) for tech, names in TECHNOLOGIES.items()]
    return F.array_compact(F.array(*found))


def sentences_with(text: Column, words: str, most: int = 20) -> Column:
    """The first sentences of a description that have one of the words (a pattern)."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\s*[•·]\s*")
    return F.slice(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.lower(s).rlike(rf"\b(?:{words})\b")), 1, most)


def _best(patterns: list[tuple[str, float]], text: Column) -> Column:
    return reduce(F.greatest, [F.when(text.rlike(p), w).otherwise(0.0) for p, w in patterns])


def _labels(patterns: dict[str, str], text: Column) -> Column:
    """Labels whose pattern fits a text in lower case."""
    held = lambda label: reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in NEEDLES.get(label, [label.lower()])])
    return F.array_compact(F.array(*(F.when(held(label) & text.rlike(p), F.lit(label)) for label, p in patterns.items())))


def _bind(values: dict[str, Column], use) -> Column:
    """`use` of a struct of the values, each of which is computed once however often it is used."""
    one = F.array(F.struct(*(v.alias(n) for n, v in values.items())))
    return F.get(F.transform(one, use), F.lit(0))


def classify_role(title: Column, description: Column, company: Column) -> Column:
    """struct(category, relevance, signals), decided by the first rule that fits.

    The employer's own name is taken out of the description, so that it is no
    sign of a technology. Without a title the category is unclassified.
    """
    name = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    body = F.lower(F.coalesce(description, F.lit("")))
    whole = F.concat(F.lit(r"\b"), F.regexp_replace(name, r"([^a-z0-9 ])", r"\\$1"), F.lit(r"\b"))  # not inside longer words
    # A name that the text doesn't hold needs no search by pattern, which is another one for each row.
    plain = lambda t: F.when((F.char_length(t["name"]) >= 3) & F.contains(t["body"], t["name"]), F.regexp_replace(t["body"], t["whole"], F.lit(" "))).otherwise(t["body"])
    values = {"title": F.lower(F.trim(F.coalesce(title, F.lit("")))), "body": body, "name": name, "whole": whole}
    named = lambda t: F.struct(t["title"].alias("title"), plain(t).alias("body"))
    return _bind({"t": _bind(values, named)}, lambda x: _bind({"title": x["t"]["title"], "body": x["t"]["body"], "text": F.concat_ws("\n", x["t"]["title"], x["t"]["body"])}, _features))


def _features(t: Column) -> Column:
    low, text = t["title"], t["text"]
    # What stands before a comma, bar, bracket or dash names the role; a team's name after it does not.
    first = F.get(F.split(low, FIRST_PART, 2), F.lit(0))
    kinds = lambda pattern: F.size(F.array_distinct(F.regexp_extract_all(t["body"], F.lit(pattern), F.lit(1))))
    best = {n: _best(p, low) for n, p in (("data", DATA_TITLES), ("platform", PLATFORM_TITLES), ("adjacent", ADJACENT_TITLES), ("hard", HARD_TITLES))}
    found = {n: low.rlike(p) for n, p in (("excluded", EXCLUDED), ("enterprise", ENTERPRISE), ("specialty", SPECIALTIES), ("master", MASTER_DATA), ("generic", GENERIC), ("engineering", ENGINEERING))}
    other = {
        "title": low,
        "signals": _labels(SIGNALS, text),
        "platform_signals": _labels(PLATFORM_SIGNALS, text),
        "first_adjacent": (_best(ADJACENT_TITLES, first) > 0) & (_best(DATA_TITLES, first) == 0),
        # Asked for data titles alone.
        "off_topic": (best["data"] > 0) & (F.char_length(t["body"]) >= OFF_TOPIC_FROM) & ((kinds(HARDWARE_WORDS) >= 2) | (kinds(ANALYST_WORDS) >= 3)),
    }
    return _bind(best | found | other, _decide)


def _decide(f: Column) -> Column:
    many, data = F.size(f["signals"]), f["data"]
    no_data, lift = data == 0, F.when(many >= 3, 0.05).otherwise(0.0)
    core = F.arrays_overlap(f["signals"], F.array(*(F.lit(c) for c in CORE_SIGNALS)))
    rules = [
        (f["title"] == "", "unclassified", F.lit(0.0)),
        (f["excluded"], "non_target", F.lit(0.02)),
        (no_data & f["enterprise"], "other_engineering", F.lit(0.2)),
        (no_data & (f["hard"] > 0), "non_target", f["hard"]),
        (no_data & f["specialty"], "other_engineering", F.lit(0.2)),
        (~no_data & f["master"], "adjacent_data", F.lit(0.3)),
        ((f["adjacent"] > 0) & (no_data | f["first_adjacent"]), "adjacent_data", F.when(many >= 4, F.least(F.lit(0.65), f["adjacent"] + 0.1)).otherwise(f["adjacent"])),
        (~no_data & (many == 0) & f["off_topic"], "adjacent_data", F.lit(0.3)),
        (~no_data, "data_engineering", F.least(F.lit(1.0), data + lift - F.when(f["hard"] > 0, 0.2).otherwise(0.0))),
        (f["platform"] > 0, "platform_infrastructure", F.least(F.lit(1.0), f["platform"] + lift)),
        (f["generic"] & (many >= 4) & core, "data_engineering", F.lit(0.6)),
        (f["generic"] & (F.size(f["platform_signals"]) >= 3), "platform_infrastructure", F.lit(0.55)),
        (f["generic"], "other_engineering", F.lit(0.25)),
        (f["engineering"], "other_engineering", F.lit(0.2)),
        (F.lit(True), "non_target", F.lit(0.05)),
    ]
    pick = lambda k: F.coalesce(*(F.when(rule[0], F.lit(rule[1]) if k == 1 else rule[2]) for rule in rules))
    return F.struct(pick(1).alias("category"), F.round(pick(2), 2).alias("relevance"), F.array_union(f["signals"], f["platform_signals"]).alias("signals"))


def is_target(category: Column, relevance: Column) -> Column:
    return category.isin(*TARGET_CATEGORIES) & (relevance >= TARGET_FROM)


def names_target(title: Column, description: Column, company: Column) -> Column:
    """Whether classify_role finds a target role. The title alone decides most rows; a description is looked through, as a whole, only where it can matter."""
    low, any_of = F.lower(F.trim(F.coalesce(title, F.lit("")))), lambda patterns: "|".join(f"(?:{p})" for p, _ in patterns)
    fits = lambda patterns, value=low: value.rlike(any_of(patterns))
    first = F.get(F.split(low, FIRST_PART, 2), F.lit(0))
    other_first = fits(ADJACENT_TITLES) & fits(ADJACENT_TITLES, first) & ~fits(DATA_TITLES, first)
    short = F.char_length(F.lower(F.coalesce(description, F.lit("")))) < OFF_TOPIC_FROM
    whole = _bind({"role": classify_role(title, description, company)}, lambda x: is_target(x["role"]["category"], x["role"]["relevance"]))
    strong, weak = ([p for p in PLATFORM_TITLES if (p[1] >= TARGET_FROM) == k] for k in (True, False))
    away = low.rlike(ENTERPRISE) | fits(HARD_TITLES) | low.rlike(SPECIALTIES) | fits(ADJACENT_TITLES)
    decided = (
        F.when(low.rlike(EXCLUDED), False)
        .when(fits(DATA_TITLES), F.when(low.rlike(MASTER_DATA) | other_first, False).when(short, True))
        .when(fits(strong), ~away)
        .when(fits(weak) | low.rlike(GENERIC), F.when(away, False))
        .otherwise(False)
    )
    return F.coalesce(decided, whole)


def years_required(text: Column) -> Column:
    """struct(low, high) of "3-5 years" or "3+ years" near talk of experience; above 30 it is no requirement."""
    pattern = r"(?i)(\d{1,2})\s*(?:\+|(?:-|to|–)\s*(\d{1,2})\s*\+?)?\s*(?:years?|yrs)"
    talk = F.lower(text).rlike(r"\b(?:experience|exp\b|years? of|background|working)") | F.lower(text).rlike(r"\d+\s*\+\s*(?:years?|yrs)")
    low, high = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    ok = talk & (low <= 30)
    return F.struct(F.when(ok, low).alias("low"), F.when(ok, high).alias("high"))


def seniority(title: Column, years: Column) -> Column:
    """By the title, else by the years asked for, else unknown."""
    out, low = F.lit(None).cast("string"), F.lower(F.coalesce(title, F.lit("")))
    for level, pattern in reversed(LEVELS):
        out = F.when(low.rlike(pattern), level).otherwise(out)
    by_years = F.when(years < 2, "junior").when(years < 5, "mid").when(years < 8, "senior").when(years < 12, "staff").when(years >= 12, "principal").otherwise("unknown")
    return F.coalesce(out, by_years)


def compensation(text: Column) -> Column:
    """struct(min, max, currency, period) of the first pay range; null fields without one or if it runs backwards."""
    pattern = r"(?i)(USD|INR|GBP|EUR|RS\.?|[$₹£€])\s?(\d[\d,]*(?:\.\d+)?)\s?(k|lpa|lakhs?|l|cr|m)?\s?(?:-|to|–)\s?(?:USD|INR|GBP|EUR|RS\.?|[$₹£€])?\s?(\d[\d,]*(?:\.\d+)?)\s?(k|lpa|lakhs?|l|cr|m)?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    unit = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    factor = lambda u: F.coalesce(F.try_element_at(unit, F.lower(u)), F.lit(1.0))
    number = lambda k: F.replace(part(k), F.lit(","), F.lit("")).try_cast("double")
    low = number(2) * factor(F.coalesce(F.nullif(part(3), F.lit("")), part(5)))
    high = number(4) * factor(part(5))
    code = F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair))
    currency = F.coalesce(F.try_element_at(code, F.upper(part(1))), F.upper(part(1)))
    ok = (low > 0) & (high >= low)
    period = F.when(F.lower(text).rlike(r"\bhour|/hr\b"), "hour").otherwise("year")
    return F.struct(F.when(ok, low).alias("min"), F.when(ok, high).alias("max"), F.when(ok, currency).alias("currency"), F.when(ok, period).alias("period"))


def platform_of(url: Column) -> Column:
    """struct(platform, key): the applicant system that hosts a URL and the board's name there; nulls if unknown."""
    at = lambda pattern: F.nullif(F.regexp_extract(url, r"(?i)^https?://" + pattern, 1), F.lit(""))
    known = {
        "greenhouse": [r"(?:job-)?boards(?:\.eu)?\.greenhouse\.io/(?!embed)([\w.%-]+)", r"boards-api\.greenhouse\.io/v1/boards/([\w.%-]+)", r"(?:job-)?boards(?:\.eu)?\.greenhouse\.io/embed[^?#]*\?(?:[^#]*&)?for=([\w.%-]+)"],
        "lever": [r"jobs(?:\.eu)?\.lever\.co/([\w.%-]+)", r"api(?:\.eu)?\.lever\.co/v0/postings/([\w.%-]+)"],
        "ashby": [r"jobs\.ashbyhq\.com/([\w.%-]+)", r"api\.ashbyhq\.com/posting-api/job-board/([\w.%-]+)"],
        "workday": [r"[a-z0-9-]+\.wd\d+\.myworkday(?:jobs|site)\.com/(?:[a-z]{2}(?:-[a-z]{2})?/)?(?!job\b|details\b|login\b)([\w.%-]+)"],
        "recruitee": [r"([a-z0-9-]+)\.recruitee\.com"],
    }
    keys = {name: F.coalesce(*(at(p) for p in patterns)) for name, patterns in known.items()}
    platform = F.coalesce(*(F.when(k.isNotNull(), F.lit(name)) for name, k in keys.items()))
    return F.struct(platform.alias("platform"), F.coalesce(*keys.values()).alias("key"))


def level_of(years: Column, title: Column) -> Column:
    """1 to 5 by title and years; a title raises the level of the years by one step at most. Null if neither says anything."""
    low = F.lower(title)
    by_title = F.when(low.rlike(r"\b(?:principal|distinguished)\b"), 5).when(low.rlike(r"\b(?:staff|lead|architect)\b"), 4).when(low.rlike(r"\b(?:senior|sr\.?)\b"), 3).when(low.rlike(r"\b(?:junior|jr\.?|intern|trainee)\b"), 1)
    by_years = F.when(years < 2, 1).when(years < 5, 2).when(years < 8, 3).when(years < 12, 4).when(years >= 12, 5)
    return F.when(by_title.isNull(), by_years).when(by_years.isNull(), by_title).otherwise(F.least(by_title, by_years + 1))


#: Role titles by which a text names an opening.
ROLE_PHRASE = (
    r"(?i)((?:(?:senior|sr\.?|lead|staff|principal|junior|jr\.?|associate)\s+)?(?:big\s+data\s+engineer|data\s+(?:platform|infrastructure|systems)\s+engineer|data\s+engineer|distributed\s+systems\s+engineer|platform\s+engineer|"
    r"infrastructure\s+engineer|software\s+engineer[\s,-]+(?:data|infrastructure)|etl\s+(?:engineer|developer)))"
)


def role_phrase(text: Column) -> Column:
    """The first role that a text names, such as senior data engineer; null without one."""
    return F.nullif(F.regexp_extract(text, ROLE_PHRASE, 1), F.lit(""))


def title_parts(title: Column) -> Column:
    """struct(company, role, location) of a result's title: "X hiring Y in Z", "Y at X - Z" or "Y - X - Z"; missing parts are null."""
    part = lambda pattern, k: F.nullif(F.trim(F.regexp_extract(title, pattern, k)), F.lit(""))
    hiring, at = r"(?i)^(.+?) (?:is )?hiring (.+?)(?: in (.+))?$", r"(?i)^(.+?) at ([^-|]+?)(?:\s+[-|]\s+(.+))?$"
    plain = r"^(.+?)\s+[-|]\s+(.+?)(?:\s+[-|]\s+(.+))?$"
    first, second = title.rlike(hiring), title.rlike(at)
    company = F.when(first, part(hiring, 1)).when(second, part(at, 2)).otherwise(part(plain, 2))
    role = F.when(first, part(hiring, 2)).when(second, part(at, 1)).otherwise(F.coalesce(part(plain, 1), F.nullif(F.trim(title), F.lit(""))))
    return F.struct(company.alias("company"), role.alias("role"), F.when(first, part(hiring, 3)).when(second, part(at, 3)).otherwise(part(plain, 3)).alias("location"))
