"""What postings and texts say: requirements, skills, terms and subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jobs, text
from ..operators import requirements, tailoring, terms
from .registry import Tables, query

def _i() -> Column:
    return F.col("o_orderkey")

_PATTERNS = terms.term_patterns()

#: The requirements that the constructed postings hold, written out by how they are built.
_ASKED = """a AS (
  SELECT o_orderkey AS k, 1 AS pos, 'required' AS kind, 'R1' AS id, CASE WHEN o_orderkey % 2 = 0 THEN ['Apache Spark'] ELSE ['Apache Kafka', 'Airflow'] END AS terms, CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE 'any' END AS mode, CASE WHEN o_orderkey % 2 = 0 THEN 5.0::DOUBLE END AS years, 1.0::DOUBLE AS importance FROM orders
  UNION ALL SELECT o_orderkey, 2, 'preferred', 'P1', ['Databricks'], 'all', NULL, 0.5 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 2, 'required', 'R2', ['Databricks', 'Airflow'], 'any', NULL, 1.0 FROM orders WHERE o_orderkey % 3 > 0
  UNION ALL SELECT o_orderkey, 4, 'responsibility', 'D1', ['Apache Kafka'], 'all', NULL, 0.7 FROM orders WHERE o_orderkey % 5 = 0)"""


def _postings(t: Tables) -> DataFrame:
    """Orders as postings with headings, items, an ignored section and a repeated item."""
    first = F.when(_i() % 2 == 0, "5+ years of experience with Apache Spark").otherwise("Strong knowledge of Kafka or Airflow")
    second = F.when(_i() % 3 == 0, "Databricks is a plus").otherwise("Knowledge of Databricks/Airflow")
    duty = F.when(_i() % 5 == 0, "Build pipelines with Kafka").otherwise("Talk to people")
    lines = [F.lit("Requirements:"), F.concat(F.lit("- "), first), F.concat(F.lit("• "), second), F.lit("Responsibilities"), duty, F.upper(duty), F.lit("Benefits"), F.lit("Kafka mugs")]
    title = F.when(_i() % 4 == 0, "Senior Data Engineer").otherwise("Data Engineer")
    return t.orders.select("o_orderkey", title.alias("title"), F.array_join(F.array(*lines), "\n").alias("description"))


def _asked(t: Tables) -> DataFrame:
    return requirements.requirements(requirements.section_items(_postings(t), "o_orderkey", "description"), "o_orderkey", _PATTERNS)


@query(f"WITH {_ASKED} SELECT k AS o_orderkey, pos, kind, id AS requirement_id, array_to_string(terms, ';') AS terms, mode, years, importance FROM a")
def requirement_items(t: Tables) -> DataFrame:
    return _asked(t).withColumn("terms", F.array_join("terms", ";")).drop("item")


@query(f"""
WITH {_ASKED}, u AS (SELECT k, kind, id, importance, unnest(terms) AS term FROM a)
SELECT k AS o_orderkey, term, round(sum(importance), 2) AS weight, bool_or(kind IN ('required', 'responsibility')) AS required, array_to_string(list_sort(list(DISTINCT id)), ';') AS requirement_ids FROM u GROUP BY 1, 2
""")
def skill_weights(t: Tables) -> DataFrame:
    return requirements.skill_weights(_asked(t), "o_orderkey").withColumn("requirement_ids", F.array_join("requirement_ids", ";"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 5.0::DOUBLE END AS years_min, CASE WHEN o_orderkey % 4 = 0 THEN 'senior' WHEN o_orderkey % 2 = 0 THEN 'senior' ELSE 'unknown' END AS seniority, 'data_engineering' AS role_focus, 2::BIGINT + (o_orderkey % 5 = 0)::BIGINT AS n_requirements,
  CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END + CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n_skills FROM orders
""")
def posting_analyses(t: Tables) -> DataFrame:
    out = requirements.analyze_postings(_postings(t), "o_orderkey", "title", "description", _PATTERNS)
    return out.select("o_orderkey", "years_min", "seniority", "role_focus", "n_requirements", F.size("skills").alias("n_skills"))


@query("""
WITH p AS (SELECT o_orderkey, ['Berlin, Germany', 'Bengaluru; Remote - India', 'London | Paris', 'Nowhere', ''][(o_orderkey % 5 + 1)::INT] AS location, CASE WHEN o_orderkey % 7 = 0 THEN 'hybrid' ELSE 'unknown' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'On-site work. We do not offer relocation.' WHEN 1 THEN 'Visa sponsorship. Relocation is paid.' ELSE 'Nothing.' END AS body FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'remote' WHEN status = 'hybrid' THEN 'hybrid' WHEN o_orderkey % 3 = 0 THEN 'onsite' ELSE 'unknown' END AS mode, [1, 2, 2, 1, 0][(o_orderkey % 5 + 1)::INT]::INT AS n_places, ['Germany', 'India', 'United Kingdom;France', '', ''][(o_orderkey % 5 + 1)::INT] AS countries,
  CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS relocation_offered, o_orderkey % 3 = 1 AS visa FROM p
""")
def location_needs(t: Tables) -> DataFrame:
    places = F.element_at(F.array(*(F.lit(x) for x in ("Berlin, Germany", "Bengaluru; Remote - India", "London | Paris", "Nowhere", ""))), (_i() % 5 + 1).cast("int"))
    body = F.when(_i() % 3 == 0, "On-site work. We do not offer relocation.").when(_i() % 3 == 1, "Visa sponsorship. Relocation is paid.").otherwise("Nothing.")
    needs = requirements.location_requirements(places, F.when(_i() % 7 == 0, "hybrid").otherwise("unknown"), body)
    rows = t.orders.select("o_orderkey", needs.alias("n"))
    return rows.select("o_orderkey", "n.mode", F.size("n.places").alias("n_places"), F.array_join("n.countries", ";").alias("countries"), "n.relocation_offered", F.col("n.visa_sponsorship_mentioned").alias("visa"))


_WORDS = {"Email": ["e-?mail", "mail"], "License": ["license", "licence"], "Token": ["token", "secret", "password"], "Web": ["http", "https", "www"], "SQL": ["sql", "mysql"], "The": ["the", "la", "die"]}
_FIND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, length(regexp_extract(' ' || text || ' ', '(?is)^(.*?)[^A-Za-z0-9_](?:{'|'.join(w)})[^A-Za-z0-9_]', 1)) + 1 AS start, regexp_matches(' ' || text || ' ', '(?is)[^A-Za-z0-9_](?:{'|'.join(w)})[^A-Za-z0-9_]') AS found FROM documents" for n, w in _WORDS.items() if n != "SQL")
# SQL by its guard: no letter or slash before it, and what "server" follows is made another word of the same length.
_FIND += " UNION ALL SELECT doc_id, 'SQL', length(regexp_extract(t, '(?is)^(.*?)[^A-Za-z0-9_/]sql[^A-Za-z0-9_]', 1)) + 1, regexp_matches(t, '(?is)[^A-Za-z0-9_/]sql[^A-Za-z0-9_]') FROM (SELECT doc_id, regexp_replace(' ' || text || ' ', '(?i)sql( server)', 'sq_\\1', 'g') AS t FROM documents)"


@query(f"""
WITH h AS ({_FIND}) SELECT d.doc_id, coalesce(string_agg(name, ';' ORDER BY start, name) FILTER (found), '') AS terms FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id
""")
def found_terms(t: Tables) -> DataFrame:
    """Terms of all documents in the order of their first appearance; SQL counts where its guard holds."""
    found = terms.find_terms(F.col("text"), terms.term_patterns(_WORDS))
    return t.documents.select("doc_id", F.array_join(terms.term_names(found), ";").alias("terms"))


@query("""
WITH w AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS term FROM part), g AS (SELECT DISTINCT term, 'g' || length(term) % 3 AS grp FROM w WHERE length(term) % 4 > 0)
SELECT p_brand, grp AS "group", array_to_string(list_sort(list(DISTINCT term)), ';') AS terms FROM w JOIN g USING (term) GROUP BY 1, 2
""")
def grouped_terms(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("term"))
    groups = rows.select("term").distinct().where("length(term) % 4 > 0").select("term", F.concat(F.lit("g"), (F.length("term") % 3).cast("string")).alias("group"))
    out = terms.by_group(rows, ["p_brand"], "term", groups)
    return out.select("p_brand", F.explode("groups").alias("group", "terms")).withColumn("terms", F.array_join("terms", ";"))


@query("""
WITH p AS (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, ['Payments & financial services', 'E-commerce & retail', 'Travel & mobility;Media & entertainment', '', 'AI & machine learning', 'Payments & financial services;Cybersecurity'][(k + 1)::INT] AS domains FROM p
""")
def subject_domains(t: Tables) -> DataFrame:
    """Subjects of orders' constructed texts, where one mention is not enough unless it is in the title."""
    body = F.element_at(F.array(*(F.lit(x) for x in ("Bank loans", "retail and Shopping, a chip", "games, gaming; travel and airlines", "travel", "health", "fraud, credit, a threat"))), (_i() % 6 + 1).cast("int"))
    head = F.element_at(F.array(*(F.lit(x) for x in ("", "", "", "none", "AI", "SIEM"))), (_i() % 6 + 1).cast("int"))
    return t.orders.select("o_orderkey", F.array_join(terms.find_domains(body, head, 2), ";").alias("domains"))


@query("""
SELECT s_suppkey, CASE WHEN y IS NULL AND t IS NULL THEN NULL WHEN t IS NULL THEN yl WHEN y IS NULL THEN t ELSE least(t, yl + 1) END::INT AS level FROM (
  SELECT s_suppkey, y, CASE WHEN y < 2 THEN 1 WHEN y < 5 THEN 2 WHEN y < 8 THEN 3 WHEN y < 12 THEN 4 ELSE 5 END AS yl, CASE s_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS t FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 15 END AS y FROM supplier))
""")
def title_levels(t: Tables) -> DataFrame:
    i = F.col("s_suppkey")
    title = F.when(i % 5 == 0, "Principal Engineer").when(i % 5 == 1, "Tech Lead").when(i % 5 == 2, "Sr. Engineer").when(i % 5 == 3, "Trainee").otherwise("Engineer")
    return t.supplier.select("s_suppkey", jobs.level_of(F.when(i % 6 > 0, i % 15), title).alias("level"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Beta' ELSE 'Gamma' END AS company, 'Data Engineer' AS role, CASE s_suppkey % 3 WHEN 0 THEN 'Pune' WHEN 2 THEN 'Berlin' END AS location, CASE WHEN s_suppkey % 3 = 2 THEN 'Data Engineer' ELSE 'Data Engineer' END AS phrase FROM supplier
""")
def result_titles(t: Tables) -> DataFrame:
    i = F.col("s_suppkey")
    title = F.when(i % 3 == 0, "Acme is hiring Data Engineer in Pune").when(i % 3 == 1, "Data Engineer at Beta").otherwise("Data Engineer - Gamma | Berlin")
    return t.supplier.select("s_suppkey", jobs.title_parts(title).alias("p"), jobs.role_phrase(title).alias("phrase")).select("s_suppkey", "p.*", "phrase")


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN 'data robot' WHEN 2 THEN 'Senior jobs' ELSE 'Open.ai labs' END AS shown, s_suppkey % 4 <> 2 AS plausible, 'Big Data Corp' AS tenant, s_suppkey % 4 < 2 AS listed,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.com/careers' ELSE 'https://x.com' END AS root, CASE WHEN s_suppkey % 2 = 0 THEN 3 + 2 + 1 ELSE 0 END::INT AS priority FROM supplier
""")
def company_names(t: Tables) -> DataFrame:
    i = F.col("s_suppkey")
    name = F.when(i % 4 == 0, " Acme.com -").when(i % 4 == 1, "data  robot (YC W21)").when(i % 4 == 2, "Senior jobs").otherwise("Open.ai labs")
    host = F.when(i % 4 == 0, "jobs.linkedin.com").when(i % 4 == 1, "in.indeed.com").otherwise("acme.co.uk")
    url = F.when(i % 2 == 0, "https://x.com/careers/data-engineer").otherwise("https://x.com/login")
    return t.supplier.select(
        "s_suppkey", text.display_name(name).alias("shown"), text.plausible_name(text.normalize_text(name)).alias("plausible"), text.tenant_name(F.lit("bigData-corp")).alias("tenant"),
        text.in_domains(host, ["linkedin.com", "indeed.com"]).alias("listed"), text.career_root(url).alias("root"), text.link_priority(url, F.lit(None).cast("string")).alias("priority"),
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS posted FROM orders
""")
def posted_texts(t: Tables) -> DataFrame:
    kind = F.when(_i() % 3 == 0, "date").when(_i() % 3 == 1, "local_datetime").otherwise("datetime")
    return t.orders.select("o_orderkey", text.posted_text(F.col("o_orderdate"), kind).alias("posted"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, list_distinct([l_returnflag, l_linestatus, 'P' || l_partkey % 5]) AS terms, l_quantity > 40 AS m FROM lineitem), w(term, weight) AS (VALUES ('A', 0.5), ('F', 0.25), ('P1', 1.125), ('P2', 0.0625)),
s AS (SELECT l_orderkey, l_linenumber, sum(weight) AS s FROM (SELECT *, unnest(terms) AS term FROM f) JOIN w USING (term) GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, round((coalesce(s, 0) + CASE WHEN m THEN 0.25 ELSE 0 END)::DECIMAL(20, 6), 3)::DOUBLE AS relevance FROM f LEFT JOIN s USING (l_orderkey, l_linenumber)
""")
def fact_relevance(t: Tables) -> DataFrame:
    facts = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus", F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string"))).alias("terms"), (F.col("l_quantity") > 40).alias("m"))
    weights = t.spark.createDataFrame([("A", 0.5), ("F", 0.25), ("P1", 1.125), ("P2", 0.0625)], "term string, weight double")
    return tailoring.relevance(facts, ["l_orderkey", "l_linenumber"], weights, "m").select("l_orderkey", "l_linenumber", "relevance")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS bullet, (CASE WHEN l_quantity > 20 THEN l_quantity ELSE 0 END) AS score FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, bullet) AS new_position, row_number() OVER (PARTITION BY l_orderkey ORDER BY bullet) AS old FROM r)
SELECT l_orderkey, bullet, new_position, new_position <= CASE WHEN l_orderkey % 2 = 0 THEN 3 ELSE 2 END OR (score > 0 AND new_position <= CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 3 END) AS included, CASE WHEN new_position < old THEN 'up' WHEN new_position > old THEN 'down' END AS moved FROM n
""")
def ranked_bullets(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("bullet"), F.when(F.col("l_quantity") > 20, F.col("l_quantity")).otherwise(0.0).alias("score"))
    out = tailoring.ranked_bullets(rows, ["l_orderkey"], "bullet", "score", F.col("l_orderkey") % 2 == 0, 3, 2)
    return out.select("l_orderkey", "bullet", F.col("new_position").cast("long").alias("new_position"), "included", "moved")


@query("""
SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_quantity DESC, l_linenumber, l_partkey::VARCHAR), ';') AS items, sum(l_quantity) AS total FROM lineitem GROUP BY 1
""")
def reordered_items(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("part"), "l_quantity", "l_linenumber")
    return tailoring.reordered(rows, ["l_orderkey"], "part", "l_quantity", "l_linenumber").withColumn("items", F.array_join("items", ";"))


@query("""
WITH f AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS term FROM part), r AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS term FROM part WHERE p_partkey % 97 = 0)
SELECT p_partkey, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS requirement_ids FROM f JOIN r USING (term) WHERE substr(term, 1, 1) <> 's' GROUP BY 1
""")
def requirement_links(t: Tables) -> DataFrame:
    """Parts as facts, brands with the names of a few parts as requirements; words with s are weak."""
    facts = t.part.select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("terms"))
    asked = t.part.where("p_partkey % 97 = 0").groupBy("p_brand").agg(F.array_distinct(F.flatten(F.collect_list(F.split("p_name", " ")))).alias("terms"))
    facts, asked = (df.withColumn("terms", F.filter("terms", lambda w: ~w.startswith("s"))) for df in (facts, asked))
    return tailoring.requirement_links(facts, "p_partkey", asked, "p_brand", []).withColumn("requirement_ids", F.array_join("requirement_ids", ";"))


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'GAP' ELSE 'STRONG' END AS status FROM orders), m AS (SELECT l_orderkey, bool_and(l_returnflag = 'N' AND l_linestatus = 'F') AS ok FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN status = 'GAP' AND coalesce(ok, false) THEN 'alternative' ELSE 'required' END AS importance FROM s LEFT JOIN m ON o_orderkey = l_orderkey
""")
def alternative_gaps(t: Tables) -> DataFrame:
    """Orders as skills, their lines as requirements."""
    asked = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("requirement"), "l_orderkey", F.when(F.col("l_returnflag") == "N", "any").otherwise("all").alias("mode"), F.when(F.col("l_linestatus") == "F", "MET").otherwise("GAP").alias("status"))
    ids = asked.groupBy("l_orderkey").agg(F.collect_list("requirement").alias("requirement_ids"))
    skills = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "GAP").otherwise("STRONG").alias("status"), F.lit("required").alias("importance")).join(ids, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return tailoring.alternatives(skills, ["o_orderkey"], asked.drop("l_orderkey"), "requirement").select("o_orderkey", "importance")


@query("""
WITH r AS (SELECT o_custkey AS candidate, lower(o_orderpriority) AS e, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS role_id FROM orders GROUP BY 1, 2)
SELECT c_custkey AS candidate, role_id FROM customer LEFT JOIN r ON c_custkey = candidate AND e = '1-urgent'
""")
def attached_facts(t: Tables) -> DataFrame:
    roles = t.orders.select(F.col("o_custkey").alias("candidate"), F.col("o_orderpriority").alias("employer"), F.struct("o_orderdate", "o_orderkey").alias("position"), F.col("o_orderkey").alias("role_id"))
    facts = t.customer.select(F.col("c_custkey").alias("candidate"), F.lit(" 1-URGENT ").alias("employer"))
    return tailoring.attach_facts(facts, roles).select("candidate", "role_id")


@query("""
SELECT l_suppkey, l_returnflag, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber = 1)), ';'), '') AS production, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber = 2)), ';'), '') AS project,
  coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber = 3)), ';'), '') AS self_described, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber > 3)), ';'), '') AS listed FROM lineitem GROUP BY 1, 2
""")
def concept_evidence(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    facts = t.lineitem.select("l_suppkey", "l_returnflag", F.col("l_partkey").alias("fact_id"), F.when(n == 1, "experience").when(n == 2, "project").when(n == 3, "summary").otherwise("skill_group").alias("category"))
    out = tailoring.concept_evidence(facts, ["l_suppkey", "l_returnflag"])
    return out.select("l_suppkey", "l_returnflag", *(F.array_join(c, ";").alias(c) for c in ("production", "project", "self_described", "listed")))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey AS role_id, CASE WHEN o_orderstatus = 'P' THEN 'present' ELSE strftime(o_orderdate, '%Y-%m') END AS end_date FROM orders)
SELECT o_custkey, role_id, end_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN end_date = 'present' THEN 0 ELSE 1 END, end_date, role_id) AS k FROM r) WHERE k = 1
""")
def current_roles(t: Tables) -> DataFrame:
    end = F.when(F.col("o_orderstatus") == "P", "present").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return tailoring.current_role(t.orders.select("o_custkey", F.col("o_orderkey").alias("role_id"), end.alias("end_date")), "o_custkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Python|SQL (a, b)|Git' ELSE 'x [1, {2, 3}]|y' END AS parts FROM supplier")
def split_lists(t: Tables) -> DataFrame:
    listed = F.when(F.col("s_suppkey") % 2 == 0, "Python, SQL (a, b), , Git").otherwise("x [1, {2, 3}] ,y")
    return t.supplier.select("s_suppkey", F.array_join(tailoring.split_top_level(listed), "|").alias("parts"))


@query("""
WITH r AS (SELECT o_orderkey, ['S', 'A', 'B', 'X'][(o_custkey % 4 + 1)::INT] AS tier, (o_orderkey % 100)::DOUBLE AS fit, (o_orderkey % 5)::INT AS p FROM orders)
SELECT o_orderkey, CASE tier WHEN 'B' THEN 'never' WHEN 'X' THEN 'manual' WHEN 'S' THEN CASE WHEN fit >= 50 AND p <= 2 THEN 'auto' ELSE 'manual' END ELSE 'manual' END AS decision FROM r
""")
def policy_decisions(t: Tables) -> DataFrame:
    tier = F.element_at(F.array(*(F.lit(x) for x in "SABX")), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = t.orders.select("o_orderkey", tier.alias("tier"), (_i() % 100).cast("double").alias("fit"), (_i() % 5).cast("int").alias("ordinal"))
    policies = t.spark.createDataFrame([("S", "auto", 50.0, 2), ("A", "on_request", 0.0, 4), ("B", "off", 0.0, 4)], "tier string, mode string, least_fit double, worst_class int")
    return tailoring.apply_policy(rows, policies, "ordinal").select("o_orderkey", "decision")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber AS p, CASE l_linenumber WHEN 1 THEN '# ' WHEN 2 THEN '## ' ELSE '- ' END AS mark, CASE l_linenumber WHEN 1 THEN 'h1' WHEN 2 THEN 'h2' ELSE 'li' END AS tag, 'a < b & ' || l_partkey AS text FROM lineitem),
r AS (SELECT l_orderkey, string_agg(mark || text, chr(10) ORDER BY p, mark || text) AS markdown, string_agg(text, chr(10) ORDER BY p, mark || text) AS text, string_agg('<' || tag || '>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</' || tag || '>', chr(10) ORDER BY p, mark || text) AS html FROM b GROUP BY 1)
SELECT *, 'variants/' || sha256(markdown) || '.md' AS path FROM r
""")
def rendered_variants(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    blocks = t.lineitem.select("l_orderkey", n.alias("position"), F.when(n == 1, "title").when(n == 2, "section").otherwise("bullet").alias("kind"), F.concat(F.lit("a < b & "), F.col("l_partkey").cast("string")).alias("text"))
    return tailoring.rendered(blocks, ["l_orderkey"], "position")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3 THEN 'queued' ELSE 'deferred' END AS state FROM orders
""")
def tailor_queue(t: Tables) -> DataFrame:
    out = tailoring.tailor_queue(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    return out.select("o_orderkey", F.col("place").cast("long").alias("place"), "state")
