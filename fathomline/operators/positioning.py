"""Which archetype a text speaks for, and which terms that brings forward: sparse weighted vectors as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gazetteer import find_names

#: What each signal adds to its terms, and the most that a term gets.
BOOST, MOST = 0.3, 0.6
#: Signals that companies and archetypes value.
PROFILES = {
    "Amazon": ["scale", "ownership", "operational excellence", "distributed systems", "customer impact"],
    "Microsoft": ["Azure", "cloud infrastructure", "engineering systems", "platform thinking"],
    "Uber": ["distributed systems", "real-time data", "marketplace infrastructure", "large-scale engineering"],
    "Databricks": ["data infrastructure", "Spark", "lakehouse", "distributed systems"],
}
ARCHETYPES = {
    "data_platform": ["data platform", "reliability", "storage", "concurrency", "distributed processing", "cloud infrastructure"],
    "fintech": ["production data pipelines", "scale", "data quality", "reliability", "business-critical systems"],
    "ai": ["data infrastructure", "large-scale pipelines", "distributed processing", "data availability", "platform engineering"],
    "startup": ["ownership", "breadth", "building systems", "debugging", "speed", "end-to-end execution"],
}
#: Terms that a signal brings forward.
SIGNAL_TERMS = {
    "scale": ["Scalability / high throughput"],
    "large-scale engineering": ["Scalability / high throughput", "Distributed systems"],
    "large-scale pipelines": ["Scalability / high throughput", "Data pipelines / ETL"],
    "ownership": ["Ownership & end-to-end delivery", "Data migration"],
    "end-to-end execution": ["Ownership & end-to-end delivery"],
    "operational excellence": ["Reliability / fault tolerance", "Observability & monitoring"],
    "distributed systems": ["Distributed systems", "Concurrency"],
    "distributed processing": ["Distributed systems", "Spark"],
    "customer impact": ["Low-latency serving", "API development"],
    "azure": ["Azure", "Azure Data Factory", "Databricks"],
    "cloud infrastructure": ["Cloud data platforms", "Azure"],
    "engineering systems": ["CI/CD & DevOps", "Observability & monitoring"],
    "platform thinking": ["Data platform engineering", "Metadata-driven frameworks"],
    "real-time data": ["Streaming / real-time processing", "Kafka", "Change data capture (CDC)"],
    "marketplace infrastructure": ["Low-latency serving", "API development", "Caching"],
    "data infrastructure": ["Data platform engineering", "Data pipelines / ETL"],
    "spark": ["Spark", "Performance tuning"],
    "lakehouse": ["Data lake / lakehouse", "Delta Lake"],
    "data platform": ["Data platform engineering"],
    "reliability": ["Reliability / fault tolerance"],
    "storage": ["Partitioning & storage layout", "Data lake / lakehouse"],
    "concurrency": ["Concurrency", "Rate limiting & backpressure"],
    "production data pipelines": ["Data pipelines / ETL", "Data ingestion"],
    "data quality": ["Data quality"],
    "business-critical systems": ["Reliability / fault tolerance", "Low-latency serving"],
    "data availability": ["Reliability / fault tolerance", "Change data capture (CDC)"],
    "platform engineering": ["Data platform engineering"],
    "building systems": ["System design & architecture"],
    "debugging": ["Performance tuning"],
}


def archetypes(sources: DataFrame, id_col: str, hints: DataFrame) -> DataFrame:
    """id, archetype, source, hint: the first archetype that a source of a row hints at.

    `sources` has the id, source (where a text is from), rank (sources of lower
    rank come first) and text, in any number of rows; `hints` has archetype,
    rank (archetypes of lower rank come first) and alias, found as whole names in any case.
    Archetypes are tried in their order, and for each the sources in theirs; of
    several hints in a text the first counts, of two at one place the longer. Rows without a hint are left out.
    """
    texts = sources.select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.col("rank").alias("_rank"), "text").withColumn("_key", F.monotonically_increasing_id())
    # The same word may hint at several archetypes, so a hint's term names its archetype.
    named = hints.select(F.concat_ws("\x01", F.format_string("%09d", F.col("rank").cast("int")), "archetype").alias("term"), "alias")
    found = find_names(texts.withColumn("_key", F.struct("_id", "_source", "_rank")), "_key", "text", named, longest=False)
    rows = found.select("_key.*", F.explode("terms").alias("t"))
    rows = rows.select("_id", F.struct(F.substring("t.name", 1, 9).alias("order"), F.col("_rank").alias("rank"), F.col("t.start").alias("start"), F.split_part("t.name", F.lit("\x01"), F.lit(2)).alias("archetype"), F.col("_source").alias("source"), F.col("t.text").alias("hint")).alias("h"))
    return rows.groupBy("_id").agg(F.min("h").alias("h")).select(F.col("_id").alias(id_col), "h.archetype", "h.source", "h.hint")


def signal_table(spark, values: dict[str, list[str]], of: str) -> DataFrame:
    """(`of`, place, signal) of settings such as PROFILES."""
    return spark.createDataFrame([(name, i, s) for name, signals in values.items() for i, s in enumerate(signals)], f"{of} string, place int, signal string")


def term_table(spark, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(signal, term)."""
    return spark.createDataFrame([(s, t) for s, ts in (terms or SIGNAL_TERMS).items() for t in ts], "signal string, term string")


def positions(rows: DataFrame, id_col: str, profiles: DataFrame, styles: DataFrame, terms: DataFrame, boost: float = BOOST, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(signals, boosts): what is valued, in order, and the terms that this brings forward.

    `rows` has the id, company (a normalised key, may be null) and archetype (may be null);
    `profiles` (company, place, signal), `styles` (archetype, place, signal) and
    `terms` (signal in lower case, term) are settings. Signals of the company's profile come first,
    then those of the archetype that it lacks. A term gets `boost` for each
    signal, `most` at most. Rows without signals have none of either.
    """
    own = rows.join(profiles, "company").select(id_col, F.lit(0).alias("kind"), "place", "signal")
    style = rows.join(styles, "archetype").select(id_col, F.lit(1).alias("kind"), "place", "signal")
    first = own.unionByName(style).groupBy(id_col, "signal").agg(F.min(F.struct("kind", "place")).alias("at"))
    signals = first.select(id_col, "signal", "at.kind", "at.place")
    boosts = signals.withColumn("_s", F.lower("signal")).join(terms.withColumnRenamed("signal", "_s"), "_s").groupBy(id_col, "term").agg(F.count("*").alias("n"))
    return signals, boosts.select(id_col, "term", F.round(F.least(F.lit(most), F.col("n") * F.lit(boost)), 2).alias("boost"))


def nearest_label(vectors: DataFrame, id_col: str, labels: DataFrame) -> DataFrame:
    """id, label, score: the label whose weighted terms a row's own terms fit best, by one join and one aggregation.

    `vectors` has the id, term and weight, `labels` label, term and weight. The
    score is the sum of products; ties go to the label first in order, and rows without a common term are left out.
    Sums are of decimals, so they don't depend on the order of rows.
    """
    exact = lambda c: F.col(c).cast("decimal(18,6)")
    met = vectors.select(id_col, "term", exact("weight").alias("_a")).join(labels.select("label", "term", exact("weight").alias("_b")), "term")
    sums = met.groupBy(id_col, "label").agg(F.sum((F.col("_a") * F.col("_b")).cast("decimal(38,12)")).alias("s"))
    best = sums.groupBy(id_col).agg(F.min(F.struct((-F.col("s")).alias("s"), "label")).alias("b"))
    return best.select(id_col, "b.label", (-F.col("b.s")).cast("double").alias("score"))
