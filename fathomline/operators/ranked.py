"""Latest, first, best and next rows of a group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task gets at most on average, where Spark would go by compressed bytes.
TASK_ROWS = 400_000


def spread(df: DataFrame, rows: int, *keys: str, most: int | None = None) -> DataFrame:
    """`df` of about so many rows, dealt by keys over so many tasks that none grows with the table: `most` rows a task, or TASK_ROWS.

    Spark merges tasks by their compressed bytes, which say little of rows that are much alike.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // (most or TASK_ROWS)))
    return df.repartition(tasks, *keys)


def once(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, each of which is computed once a row, also where it is filtered by or used often."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.select(*kept, made.alias("_made")).select(*kept, *(F.col(f"_made.{name}").alias(name) for name in columns))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Of each group the named columns of its last row, by aggregation alone."""
    last = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *(f"_last.{c}" for c in columns))


def top_terms(df: DataFrame, key: str, term: str, k: int) -> DataFrame:
    """Each key's k most frequent terms; ties by name."""
    counts = df.where(F.col(term).isNotNull()).groupBy(key, term).agg(F.count("*").alias("n"))
    return top(counts, [key], [F.desc("n"), F.asc(term)], k, "rank")


def near_best(df: DataFrame, keys: list[str], score: str, share: float, order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group whose score is at least a share of the group's best."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return top(df.withColumn("_best", best).where(F.col(score) >= share * F.col("_best")).drop("_best"), keys, order, k, "rank")


def plan(df: DataFrame, company: str, posting: str, ordinal: str, score: str, tie: str, size: int) -> DataFrame:
    """The day's plan: classes in order, within a class companies that were used least, then the score.

    Of re-posts (the same company and posting) the best counts. Choosing greedily
    equals ordering by class, then by the row's place within its company, then by
    score; so the table is reduced by windows per company and one top-k.
    """
    best = [F.asc(ordinal), F.desc(score), F.asc(tie)]
    once = top(df, [company, posting], best)
    seen = once.withColumn("turn", F.row_number().over(Window.partitionBy(company).orderBy(*best)) - 1)
    return seen.orderBy(F.asc(ordinal), F.asc("turn"), F.desc(score), F.asc(tie)).limit(size)


def within_budget(df: DataFrame, order: list[str], minutes: str, most_items: int, budget: int) -> DataFrame:
    """Rows of a short plan that fit a budget: the first always, later ones if they still fit, at most so many."""
    names = df.columns
    rows = F.sort_array(F.collect_list(F.struct(*order, *(c for c in names if c not in order))))
    kind = df.select(F.array(F.struct(*order, *(c for c in names if c not in order))).alias("x")).schema["x"].dataType.simpleString()
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept"))

    def step(s: Column, r: Column) -> Column:
        cost = F.coalesce(r[minutes].cast("long"), F.lit(45).cast("long"))
        fits = (F.size(s["kept"]) < most_items) & ((F.size(s["kept"]) == 0) | (s["used"] + cost <= budget))
        return F.struct(F.when(fits, s["used"] + cost).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(r))).otherwise(s["kept"]).alias("kept"))

    kept = df.agg(F.aggregate(rows, empty, step, lambda s: s["kept"]).alias("kept"))
    return kept.select(F.explode("kept").alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in names))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null at or before each row, like a heading over the lines under it."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def numbered(df: DataFrame, keys: list[str], order: list[Column], prefix: Column, name: str) -> DataFrame:
    """Adds labels like R1, R2: the prefix and the place within its group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.concat(prefix, place.cast("string")))


def next_version(new: DataFrame, old: DataFrame, keys: list[str], order: list[Column], version: str) -> DataFrame:
    """Numbers new rows on from the highest version of their key."""
    last = old.groupBy(*keys).agg(F.max(version).alias("_last"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.join(last, keys, "left").withColumn(version, F.coalesce("_last", F.lit(0)) + place).drop("_last")


def runs_of(df: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """Each run of consecutive failures of a key: its number, length, first and last place.

    A run is what lies between two successes; `order` must be total.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(failed).groupBy(*keys, F.col("_run").alias("run")).agg(F.count("*").alias("length"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key the total length of the union of its intervals; empty intervals and null ends are left out.

    An interval opens a new island if it starts after all before it have ended.
    """
    by = Window.partitionBy(*keys).orderBy(start, end)
    rows = df.where(F.col(end) > F.col(start)).withColumn("_reach", F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col(start) > F.col("_reach"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "_island").agg(F.min(start).alias("_from"), F.max(end).alias("_to"))
    return islands.groupBy(*keys).agg(F.sum(F.col("_to") - F.col("_from")).alias("covered"), F.count("*").alias("islands"))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed and kept in the folder of spark.checkpoint.dir. Without one a local session takes a temporary folder; any other fails."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """checkpointed() as Parquet: a fraction of the disk where columns repeat themselves, and later steps read the columns that they need."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; a component is its smallest node, of any type that has an order.

    Each round takes the smallest label among a node's neighbours and then that
    label's own label, so paths shorten fast. Loops and repeated edges have no effect
    beyond naming their nodes; edges with a null end are left out.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).dropna()
    both = checkpointed(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("_theirs")), "other").groupBy("node").agg(F.min("_theirs").alias("_least"))
        nearer = labels.join(heard, "node").select("node", "component", F.least("component", "_least").alias("_label"))
        onward = labels.select(F.col("node").alias("_label"), F.col("component").alias("_next"))
        step = checkpointed(nearer.join(onward, "_label").select("node", F.least("_label", "_next").alias("_new"), "component"))
        labels = step.select("node", F.col("_new").alias("component"))
        if step.where("_new <> component").isEmpty():
            return labels


def closure(edges: DataFrame, source: str, target: str, rounds: int = 16) -> DataFrame:
    """All (source, target) pairs reachable over a small table of implications, such as a taxonomy.

    Each round is checkpointed. Each round doubles the paths' length; `rounds` doublings reach any path of a table with fewer than 2^rounds nodes.
    """
    pairs = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).where("source <> target").distinct()
    size = pairs.count()
    for _ in range(rounds):
        step = pairs.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        longer = pairs.join(step, "target").select("source", F.col("_next").alias("target")).where("source <> target")
        pairs = checkpointed(pairs.unionByName(longer).distinct())
        grown = pairs.count()
        if grown == size:
            break
        size = grown
    return pairs


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "values") -> DataFrame:
    """Per key the distinct values as an array, each at the place where it comes first; nulls are left out.

    Values are made distinct before they are gathered, so an array is as long as a key has values.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(name))
