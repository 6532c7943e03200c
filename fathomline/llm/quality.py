"""Quality scores by Bradley-Terry pairwise ranking.

A document labelled 1 is preferred to one labelled 0. Weights are learnt by
logistic loss on the differences of the two documents' features; a document's
strength is the weighted sum of its features, and the strength at a quantile of
the training documents becomes the threshold, at which the score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, map_rows, read, text_bytes

#: Preferred documents are paired with so many others each.
PAIRS = 4
PENALTY = 1e-4

FEATURES = ["length", "lower", "upper", "digit", "space", "line", "stop", "symbol", "high", "word", "word_spread", "distinct", "distinct_runs", "distinct_lines", "title", "bare"]

_CLASS = np.full(256, 7)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[46, 44]] = 4, 5, 6


def features(text: bytes) -> list[float]:
    """One number for each of FEATURES, from the whole text; zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    shares = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 9)[1:] / len(text)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    runs = set(zip(words, words[1:], words[2:])) or {()}
    lines = text.split(b"\n")
    return [
        math.log1p(len(words)),
        *shares.tolist(),
        float(sizes.mean()),
        float(sizes.std()),
        len(set(words)) / len(words),
        len(runs) / max(1, len(words) - 2),
        len(set(lines)) / len(lines),
        sum(map(bytes.istitle, words)) / len(words),
        sum(map(bytes.isalpha, words)) / len(words),
    ]


def with_features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def rows(batch: list[dict]) -> list[dict]:
        return [{"doc_id": r["doc_id"], "x": features(r["data"])} for r in batch]

    arrow = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data")), rows, "doc_id long, x array<double>", arrow)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Ranking:
    """Strength = sum(weights * (features - centre)); the score is 0.5 at `threshold`."""

    centre: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    spread: float

    def score(self, x: list[float]) -> float:
        z = (sum(w * (v - c) for w, v, c in zip(self.weights, x, self.centre)) - self.threshold) / self.spread
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Learn from all labelled rows that are not held out.

    Labels that are null are left out; of an id's several labels the largest
    counts. With only one label present, every document scores 0.5. Features go
    to the labels, so no text is shuffled.
    """
    return fit_features(with_features(docs.where(~held_out(id_col)), id_col, text_col), labels, label_col, id_col)


def fit_features(table: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Ranking:
    """The same from the features of documents, as with_features gives them."""
    usable = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    table = table.join(usable, "doc_id").select("doc_id", "_label", "x").cache()
    try:
        n, better, *moments = table.agg(F.count("*"), F.sum("_label"), *(f(F.get("x", F.lit(i))) for i in range(len(FEATURES)) for f in (F.avg, F.stddev_pop))).first()
        if not n or better in (0, n):
            return Ranking((0.0,) * len(FEATURES), (0.0,) * len(FEATURES), 0.0, 1.0)
        centre, scale = np.array(moments[::2]), np.array(moments[1::2])
        scale = np.where(scale > 1e-12, scale, 1.0)
        worse = n - better
        # The i-th preferred document meets the others numbered i * PAIRS + 0, 1, ...: an equi-join on that number.
        ranked = _numbered(table)
        many = max(1, math.ceil(PAIRS * max(1.0, worse / better)))
        left = ranked.where("_label = 1").select(F.col("x").alias("_a"), "_i", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("_k"))
        left = left.select("_a", F.pmod(F.col("_i") * many + F.col("_k"), F.lit(worse)).alias("_j"))
        right = ranked.where("_label = 0").select(F.col("x").alias("_b"), F.col("_i").alias("_j"))
        size = F.array(*(F.lit(float(s)) for s in scale))
        gap = F.zip_with(F.zip_with("_a", "_b", lambda a, b: a - b), size, lambda d, s: d / s)
        weights = least_loss(left.join(right, "_j").select(gap.alias("_d")), len(FEATURES)) / scale
        terms = [(F.get("x", F.lit(i)) - float(c)) * float(w) for i, (c, w) in enumerate(zip(centre, weights))]
        strength = table.select(sum(terms[1:], terms[0]).alias("s"))
        spread = strength.agg(F.stddev_pop("s")).first()[0]
        threshold = exact_quantile(strength, "s", worse / n)
    finally:
        table.unpersist()
    return Ranking(tuple(map(float, centre)), tuple(map(float, weights)), threshold, float(max(spread / 4, 1e-9)))


def least_loss(pairs: DataFrame, size: int, penalty: float = PENALTY, steps: int = 60) -> np.ndarray:
    """The weights w of least mean log(1 + exp(-w * d)) over all pairs (_d: array of `size` finite numbers), plus half the penalty times w * w.

    Newton's method with halved steps. Each step is one job of one stage over the
    cached pairs, of which a task returns only its sums; a first-order method
    takes several times as many jobs, of which the driver keeps a record each.
    """
    upper = np.triu_indices(size)
    pairs = pairs.cache()

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature at w."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, slope, bend = 0, 0.0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                d = batch["_d"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                z = d @ w
                wrong = np.exp(-np.logaddexp(0, z))
                n, loss = n + len(d), loss + float(np.logaddexp(0, -z).sum())
                slope -= wrong @ d
                bend += (d * (wrong * (1 - wrong))[:, None]).T @ d
            if n:
                yield pa.RecordBatch.from_pylist([{"s": [float(n), loss, *slope.tolist(), *bend[upper].tolist()]}], schema=pa.schema([("s", pa.list_(pa.float64()))]))

        n, loss, *rest = np.sum([r["s"] for r in pairs.mapInArrow(sums, "s array<double>").collect()], axis=0)
        bend = np.zeros((size, size))
        bend[upper] = bend.T[upper] = np.array(rest[size:]) / n
        return loss / n + penalty / 2 * float(w @ w), np.array(rest[:size]) / n + penalty * w, bend + penalty * np.eye(size)

    try:
        w, share = np.zeros(size), 1.0
        loss, slope, bend = look(w)
        step = np.linalg.solve(bend, -slope)
        for _ in range(steps):
            gain = float(-slope @ step)  # about twice what the loss is above the least
            if gain <= 1e-14 * (1 + loss) or share < 1e-6:
                break
            new = look(w + share * step)
            if new[0] > loss - 1e-4 * share * gain:
                share /= 2
                continue
            w, share, (loss, slope, bend) = w + share * step, 1.0, new
            step = np.linalg.solve(bend, -slope)
    finally:
        pairs.unpersist()
    return w


def _numbered(table: DataFrame) -> DataFrame:
    """Adds _i, a row's number from 0 among those of its label in the order of hashes; counted in ranges of hashes, so no task gets all rows of a label."""
    key = F.xxhash64("doc_id")
    rows = table.withColumn("_range", F.shiftright(key, 52))
    ends = Window.partitionBy("_label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_label", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ends), F.lit(0)))  # 4,096 ranges a label
    place = F.row_number().over(Window.partitionBy("_label", "_range").orderBy(key, "doc_id")) - 1
    return rows.withColumn("_place", place).join(F.broadcast(before.drop("_n")), ["_label", "_range"]).select("doc_id", "_label", "x", (F.col("_place") + F.col("_before")).alias("_i"))


def exact_quantile(rows: DataFrame, column: str, share: float, bins: int = 4096) -> float:
    """The quantile of all finite values, interpolated between neighbours. Bins around it are narrowed until they hold few values, so at most about `bins` numbers come to the driver at once."""
    n, low, high = rows.agg(F.count(column), F.min(column), F.max(column)).first()
    at = share * (n - 1)

    def nth(k: int) -> float:
        a, b, below = low, high, 0
        while a < b:
            part = rows.where(F.col(column).between(a, b))
            step = (b - a) / bins
            if not step:
                break
            counts = part.groupBy(F.least(F.floor((F.col(column) - a) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
            for r in sorted(counts, key=lambda r: r["bin"]):
                if below + r["n"] > k:
                    a, b = r["a"], r["b"]
                    break
                below += r["n"]
            if len(counts) == 1:
                break
        if a == b:
            return a
        # Neighbouring numbers that no bins tell apart.
        for r in rows.where(F.col(column).between(a, b)).groupBy(column).count().orderBy(column).collect():
            if below + r["count"] > k:
                return r[column]
            below += r["count"]

    first, part = nth(math.floor(at)), at - math.floor(at)
    if not part:
        return first
    # The value after it is the same one or the least above it.
    upto, above = rows.agg(F.count_if(F.col(column) <= first), F.min(F.when(F.col(column) > first, F.col(column)))).first()
    return first if upto > math.floor(at) + 1 else first + part * (above - first)


def quality_scores(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, score in 0 to 1, predicted (1 from 0.5 on). Null texts score as empty ones."""
    return feature_scores(with_features(docs, id_col, text_col), ranking)


def feature_scores(table: DataFrame, ranking: Ranking) -> DataFrame:
    """quality_scores from the features of documents, as with_features gives them."""

    @F.pandas_udf("double")
    def score(xs):
        return xs.map(ranking.score)

    return table.select("doc_id", score("x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text the ranking does not reject."""

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: ranking.score(features(t)))

    return docs.where(score(text_bytes(text_col)) >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a ranking learnt from labels that aren't held out; quality_scores says what holds for odd rows."""
    # Features serve the fit and the scores, and are computed once.
    table = Shelf(spark, "quality").put("features", with_features(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return feature_scores(table, fit_features(table, read(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
