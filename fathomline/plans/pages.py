"""Text and URL functions over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import postings
from ..operators.ranked import spread
from ..sources import markup
from .registry import Tables, query

_HOST = "regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '[.]+$', '')"
_TWO = """'co.in', 'net.in', 'org.in', 'firm.in', 'gen.in', 'ind.in', 'ac.in', 'edu.in', 'gov.in', 'co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'com.sg', 'com.my',
  'co.jp', 'co.kr', 'com.br', 'com.cn', 'com.hk', 'com.tw', 'co.nz', 'co.za', 'com.mx', 'com.ar', 'com.tr', 'com.sa', 'co.id', 'com.ph', 'com.vn', 'com.pk', 'com.bd', 'co.il'"""


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?', ['s', 'n', 'p', 'q']) AS x FROM pages)
SELECT page_id, CASE WHEN x.s <> '' THEN lower(x.s) || ':' ELSE '' END || CASE WHEN x.n <> '' THEN '//' || lower(x.n) ELSE '' END || x.p ||
  CASE WHEN len(list_filter(string_split(x.q, '&'), lambda y: y <> '' AND NOT regexp_matches(lower(y), '^(utm_|gclid|fbclid|ref|source|src)'))) > 0
    THEN '?' || array_to_string(list_filter(string_split(x.q, '&'), lambda y: y <> '' AND NOT regexp_matches(lower(y), '^(utm_|gclid|fbclid|ref|source|src)')), '&') ELSE '' END AS canonical FROM p
""")
def canonical_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), l AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM h)
SELECT page_id, host, CASE WHEN len(labels) < 2 THEN NULL WHEN len(labels) >= 3 AND array_to_string(labels[-2:], '.') IN ({_TWO}) THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM l
""")
def registrable_domains(t: Tables) -> DataFrame:
    host = text.host_name(F.col("url"))
    return t.pages.select("page_id", host.alias("host"), text.registrable_domain(host).alias("domain"))


def _decoded(value: str) -> str:
    """SQL for the entities that the given pages hold."""
    return f"regexp_replace(replace(replace(replace({value}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


def _shown(value: str) -> str:
    """SQL for what shows of HTML, a line for each block."""
    for tag in ("script", "style"):
        value = f"regexp_replace({value}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    value = f"regexp_replace(regexp_replace({value}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|section|article)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({_decoded(value)}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n\\s*', chr(10), 'g'), ' ' || chr(10))"


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)
SELECT page_id, nullif(trim(regexp_replace({_decoded("t")}, '[ \t\r\n]+', ' ', 'g')), '') AS title, nullif(substr({_shown("h")}, 1, 300), '') AS heading FROM p
""")
def page_titles(t: Tables) -> DataFrame:
    return markup.titles(markup.elements(t.pages, "page_id", "html", ("title", "meta", "h1", markup.DOCUMENT), whole=True)).withColumnRenamed("id", "page_id")


@query(f"""
WITH v AS (SELECT page_id, html, {_shown(_decoded("html"))} AS v FROM pages)
SELECT page_id, length(v)::BIGINT AS n_chars, sha256(v) AS sha256, length(v) < 1500 AND (len(regexp_extract_all(lower(html), '<script')) >= 5 OR contains(html, 'id="root"') OR contains(html, 'id="app"') OR contains(html, '__NEXT_DATA__')) AS scripted FROM v
""")
def html_text(t: Tables) -> DataFrame:
    visible = text.html_to_text(F.col("html"), None, whole=True)
    return t.pages.select("page_id", F.char_length(visible).cast("long").alias("n_chars"), F.sha2(visible, 256).alias("sha256"), text.looks_script_rendered(F.col("html"), whole=True).alias("scripted"))


@query(f"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"''#][^"'']*)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"''#][^"'']*)["''][^>]*>(.*?)</a>', 2) AS l FROM pages),
r AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || {_decoded("unnest(h)")} AS link, substr({_shown("unnest(l)")}, 1, 300) AS label, unnest(range(len(h)))::INT AS place FROM a)
SELECT page_id, link, arg_min(label, place) AS label, min(place) AS place FROM r GROUP BY 1, 2
""")
def page_links(t: Tables) -> DataFrame:
    """Links of all pages, of which the given ones start with a slash."""
    return markup.links(markup.elements(t.pages, "page_id", "html", {"a"}, whole=True), _urls(t)).withColumnRenamed("id", "page_id")


def _urls(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("id"), "url")


#: Pages that one task reads at most on average.
PAGES = 500


def listing_pages(t: Tables) -> DataFrame:
    """page_id, url, html: every page, with links, a heading and structured data of a careers page made of its own words."""
    i, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>|<[^>]*>|&\\w+;?", " "), r"[^\p{L}]+", " "), " "), lambda w: F.char_length(w) > 3)
    roles = F.array(*map(F.lit, ["Data Engineer", "Sales Manager", "Platform Engineer", "Data Analyst"]))
    paths = F.array(*map(F.lit, ["/jobs/", "/careers/data-engineer/", "/blog/", "/positions/", "/about/", "/x/etl/", "https://boards.greenhouse.io/acme/jobs/", "https://elsewhere.test/jobs/"]))
    pick = lambda values, k: F.get(values, F.pmod(k, F.size(values)).cast("int"))
    link = lambda w, k: F.concat(F.lit('<li><a class="x" href="'), pick(paths, k + i), w, F.lit('"> <b>'), pick(roles, F.floor(k / 3) + i), F.lit("</b> &amp; "), w, F.lit("</a>"))
    nav = F.concat(F.lit("<ul>"), F.array_join(F.transform(words, link), ""), F.lit('</ul><a href="?page=2">Next</a>'))
    title = F.concat(pick(roles, i), F.lit(" "), F.coalesce(F.get(words, F.lit(0)), F.lit("one")))
    posting = F.concat(F.lit('{"@type": "JobPosting", "title": "'), title, F.lit('", "datePosted": "2024-01-0'), (i % 9 + 1).cast("string"), F.lit('", "jobLocation": {"address": {"addressLocality": "Remote"}}, "description": "&lt;p&gt;Spark&lt;/p&gt;",}'))
    data = F.when(i % 5 == 0, posting).when(i % 5 == 1, F.concat(F.lit('{"@graph": ['), posting, F.lit(', {"@type": "Thing"}]}'))).when(i % 5 == 2, F.concat(F.lit("["), posting, F.lit("]")))
    block = F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>")), F.lit(""))
    heading = F.when(i % 5 == 3, F.concat(F.lit("<h1>"), title, F.lit("</h1>"))).otherwise("")
    # Reading HTML costs far more than its bytes tell, and a file may be one task.
    pages = spread(t.pages.select("page_id", "url", "html"), t.pages.count(), "page_id", most=PAGES)
    return pages.select("page_id", "url", F.concat(heading, html, nav, block).alias("html"))


@query()
def page_link_scores(t: Tables) -> DataFrame:
    """How likely each link leads to a posting, over all pages as careers pages."""
    pages = listing_pages(t)
    return markup.link_scores(markup.elements(pages, "page_id", "html", {"a"}), _urls(t)).withColumnRenamed("id", "page_id")


@query()
def page_postings(t: Tables) -> DataFrame:
    """Postings of all pages as careers pages, by structured data or by heading."""
    pages = listing_pages(t)
    return markup.page_postings(markup.elements(pages, "page_id", "html", markup.POSTING_TAGS), _urls(t)).withColumnRenamed("id", "page_id")


@query("""
WITH n AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS h FROM documents)
SELECT doc_id, h AS description_hash, min(doc_id) OVER (PARTITION BY h) AS first_id FROM n
""")
def exact_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.description_hash(F.col("text")).alias("description_hash"))
    # Each text is hashed once, and only ids and hashes are shuffled.
    first = F.min("doc_id").over(Window.partitionBy("description_hash"))
    return rows.select("doc_id", "description_hash", first.alias("first_id"))


@query("""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM d WHERE len(w) >= 8),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM b WHERE len(w) >= 8)
SELECT doc_id, item_id, count(*) AS shared_grams FROM dg JOIN bg USING (gram) GROUP BY 1, 2
""")
def gram_contamination(t: Tables) -> DataFrame:
    return postings.gram_overlap(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 8)


@query("""
SELECT lang, quality, count(*) AS n, count_if(n_chars >= 500) AS long_enough, avg(n_chars) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2
""")
def quality_label_join(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return rows.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 500).alias("long_enough"), F.avg("n_chars").alias("mean_chars"))


@query("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS mean_square FROM embeddings GROUP BY 1")
def vector_norms(t: Tables) -> DataFrame:
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(square), 6).alias("mean_square"))
