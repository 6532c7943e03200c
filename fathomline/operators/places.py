"""Places of a table found in texts by hashes of their words' n-grams, the longest first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of countries, in the order in which they are tried, with their codes.
COUNTRY_CODES = [("india", "IND", "India"), ("united states", "USA", "United States"), ("usa", "USA", "United States"), ("united kingdom", "GBR", "United Kingdom"), ("uk", "GBR", "United Kingdom"), ("canada", "CAN", "Canada"), ("germany", "DEU", "Germany"), ("singapore", "SGP", "Singapore")]
#: Names of a gazetteer that every task gets; more are joined by a shuffle.
BROADCAST_NAMES = 200_000
#: Texts that a task looks at together.
SLICE = 256
#: What stands between two words.
BETWEEN = r"[^\p{L}\p{N}\p{M}]+"


def words(text: Column) -> Column:
    """The words of a text in lower case: runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def find_places(rows: DataFrame, id_col: str, text_col: str, gazetteer: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """(id, word, n, place): the places that a text names, each with its first word's number (from 1) and its number of words.

    `gazetteer` has name and place (an id or code). Names are compared word by
    word. The longest name at a word wins, and a name whose words all belong to a longer one
    that starts before it is passed over; of several places of one name the smallest counts. Up to
    `broadcast_names` names go to the tasks, which follow them word by word, and no text is
    shuffled. With more of them, runs of words as long as the longest name are matched by hash
    and confirmed by their words. `id_col` names a row; null texts have no places.
    """
    names = gazetteer.select(F.array_join(words(F.col("name")), " ").alias("name"), "place").where("name <> '' and place is not null").groupBy("name").agg(F.min("place").alias("place"))
    names = names.withColumns({"size": F.size(F.split("name", " ")), "hash": F.xxhash64("name")})
    longest, count = names.agg(F.max("size"), F.count("*")).first()
    if count <= broadcast_names:
        text = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), BETWEEN, " "))
        hits = rows.select(F.col(id_col).alias("id"), text.alias("text")).where("text <> ''").mapInArrow(_follow([r.name for r in names.select("name").collect()]), f"id {dict(rows.dtypes)[id_col]}, word int, n int, name string")
        return hits.join(F.broadcast(names.select("name", "place")), "name").select(F.col("id").alias(id_col), "word", "n", "place")
    texts = rows.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    of_word = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest or 1), F.size("w") - i + 1)), lambda k: F.struct(i.alias("word"), k.alias("size"), F.array_join(F.slice("w", i, k), " ").alias("run")))
    runs = texts.select("id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), of_word))).alias("r")).select("id", "r.word", "r.size", "r.run").withColumn("hash", F.xxhash64("run"))
    met = runs.join(names.select("hash", "name", "place"), "hash").where(F.col("run") == F.col("name"))
    found = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", (-F.col("size")).alias("size"), "place"))).alias("f"))

    def step(s: Column, x: Column) -> Column:
        new = x["word"] - x["size"] > s["reach"]
        return F.struct(F.greatest(s["reach"], x["word"] - x["size"]).alias("reach"), F.when(new, F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept"))

    kind = dict(found.dtypes)["f"]
    kept = F.aggregate("f", F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("kept")), step)["kept"]
    return found.select(F.col("id").alias(id_col), F.explode(kept).alias("_k")).select(id_col, "_k.word", (-F.col("_k.size")).alias("n"), "_k.place")


def _follow(names: list[str]):
    """For mapInArrow: (id, word, n, name) of the names in texts whose words are parted by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict = {}
        for name in names:
            at = first
            for w in name.split(" "):
                at = at.setdefault(w, {})
            at[""] = name  # no word is empty
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part, out = batch.slice(start, SLICE), ([], [], [], [])
                for row, text in enumerate(part.column("text").to_pylist()):
                    for hit in _longest(text.split(" "), first):
                        for values, v in zip(out, (row, *hit)):
                            values.append(v)
                ids = part.column("id").take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["id", "word", "n", "name"])

    return run


def _longest(found: list[str], first: dict) -> Iterator[tuple[int, int, str]]:
    """(word, n, name): the longest name at each word, if it reaches beyond those before it."""
    reach = 0
    for i, w in enumerate(found):
        at, end = first.get(w), i
        best = None
        while at is not None:
            end += 1
            if "" in at:
                best = (i + 1, end - i, at[""])
            at = at.get(found[end]) if end < len(found) else None
        if best and best[0] + best[1] > reach:
            reach = best[0] + best[1]
            yield best


def country_hints(places: Column, india: str) -> Column:
    """array<struct(code, term)> of countries that a list of preferred places speaks of, each once and in order.

    A place counts for the first country whose name it holds anywhere; else for India, if it
    names one of its cities. Null places are passed over.
    """
    struct = lambda code, term: F.struct(F.lit(code).alias("code"), F.lit(term).alias("term"))

    def one(p: Column) -> Column:
        held = [F.when(F.contains(F.lower(p), F.lit(name)), struct(code, term)) for name, code, term in COUNTRY_CODES]
        return F.coalesce(*held, F.when(p.rlike(india), struct("IND", "India")))

    return F.array_distinct(F.array_compact(F.transform(F.coalesce(places, F.array().cast("array<string>")), one)))
