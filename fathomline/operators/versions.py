"""How alike two versions of a text are, word by word, and which rows follow which."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: from this likeness on a version counts as the same text.
SAME = 0.9
#: Ids to a group in which the next one is looked for; only the ends of groups meet others.
SPAN = 4096


def common_length(a: list[str], b: list[str]) -> int:
    """Words of the longest common subsequence, for which a word of `b` costs one operation on numbers of len(a) bits."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    whole = (1 << len(a)) - 1
    open_ = whole
    for word in b:
        met = open_ & places.get(word, 0)
        open_ = ((open_ + met) | (open_ - met)) & whole
    return len(a) - open_.bit_count()


def likeness(old: str | None, new: str | None, least: float) -> tuple[str, float | None]:
    """What decided, and the ratio where it was needed.

    "words": the words that both have, in any order, are too few; "order": those
    in one order are. Both bound the ratio from above, so no pair is lost.
    "matched": the ratio itself. Two texts without words are the same.
    """
    a, b = (old or "").split(), (new or "").split()
    total = len(a) + len(b)
    if a == b:
        return "equal", 1.0
    if 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
        return "words", None
    if 2 * common_length(a, b) < least * total:
        return "order", None
    return "matched", SequenceMatcher(None, a, b, autojunk=False).ratio()


def compare_versions(pairs: DataFrame, old: str, new: str, least: float = SAME) -> DataFrame:
    """Adds decided ("equal", "words", "order" or "matched"), ratio (null unless "equal" or "matched") and same (the ratio is `least` or more).

    Words are parted by white space; null texts have none. The ratio is that of
    matching blocks without a rule for frequent words. Whole texts are compared.
    """

    @F.pandas_udf("decided string, ratio double")
    def judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([likeness(x, y, least) for x, y in zip(a, b, strict=True)], columns=["decided", "ratio"])

    rows = pairs.withColumn("_v", judge(F.col(old), F.col(new)))
    return rows.select(*pairs.columns, "_v.decided", "_v.ratio", F.coalesce(F.col("_v.ratio") >= least, F.lit(False)).alias("same"))


def following(rows: DataFrame, key: str, id_col: str, span: int = SPAN) -> DataFrame:
    """(key, id, next): for each distinct id the next larger one of its key, null for the last.

    Ids are whole numbers. They are looked through by groups of `span`
    neighbouring ids, so a key with very many rows is no single task. Null keys
    are one key; null ids are left out.
    """
    ids = rows.where(F.col(id_col).isNotNull()).select(F.col(key).alias("key"), F.col(id_col).alias("id")).distinct().withColumn("part", F.floor(F.col("id") / span))
    heads = ids.groupBy("key", "part").agg(F.min("id").alias("first"))
    heads = heads.withColumn("after", F.lead("first").over(Window.partitionBy("key").orderBy("part"))).select(F.col("key").alias("_k"), F.col("part").alias("_p"), "after")
    inner = ids.withColumn("next", F.lead("id").over(Window.partitionBy("key", "part").orderBy("id")))
    joined = inner.join(heads, F.col("key").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p")))
    return joined.select(F.col("key").alias(key), F.col("id").alias(id_col), F.coalesce("next", "after").alias("next"))


def consecutive(rows: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """key, id, next, old, new: the texts of each row and of the one after it. Only ids are ordered; texts meet by id, which names a row."""
    pairs = following(rows, key, id_col).where("next is not null")
    texts = rows.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    pairs = pairs.join(texts.withColumnsRenamed({"_i": id_col, "_t": "old"}), id_col)
    return pairs.join(texts.withColumnsRenamed({"_i": "next", "_t": "new"}), "next").select(key, id_col, "next", "old", "new")
