"""Hard negatives: rows of other labels that score nearly as high as an anchor's positives.

A pivot table brackets every score: the largest difference and the smallest sum
of stored distances bound the distance from below and above. Rows whose bracket
misses what an anchor asks for are passed over; the others are checked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, read
from .pivots import PIVOTS, ROUND, SAMPLE, Best, Chunk, Query, eliminate, look, rounds, stored, whole_vectors

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these percentages of the positive.
LOW, HIGH = 50, 95

POSITIVE_COLUMNS = ["anchor_id", "asked", "positive_id", "positive_score"]
COLUMNS = ["anchor_id", "asked", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


class Wanted:
    """Of one positive: the window of scores and the best rows in it so far."""

    def __init__(self, place: int, row: Row, negatives: int, low: int, high: int):
        self.place, self.row, self.best = place, row, Best(negatives)
        self.low, self.high = window_of(row.positive_score, low, high)

    @property
    def least(self) -> int:
        """No score below this can enter."""
        return self.low if self.best.least is None else max(self.low, self.best.least)


def visit_windows(query: Query, chunk: Chunk, wanted: list[Wanted], scores) -> None:
    """Check the rows of other labels whose bracket of scores meets one of the windows."""
    wanted = [w for w in wanted if w.least <= w.high]
    if not wanted:
        return
    lowest, highest = query.score(query.farthest(chunk)), query.score(query.nearest(chunk))
    open_ = np.zeros(len(chunk.ids), bool)
    for w in wanted:
        open_ |= (highest >= w.least) & (lowest <= w.high)
    at = np.flatnonzero(open_ & (chunk.more["label"] != query.row.label))
    found = scores(chunk.x[at], query.q)
    for w in wanted:
        fit = (found >= w.least) & (found <= w.high)
        w.best.add(found[fit], chunk.ids[at[fit]])


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, sample: int = SAMPLE, most: int = ROUND) -> DataFrame:
    """For each anchor and each of its positives the first rows of other labels in the positive's window.

    Both tables come from `whole_vectors` with a label (id, v, label); rows with
    a null label take no part. A positive is one of the `positives` other rows
    of the anchor's label with the highest inner products; a negative is one of
    the first `negatives` rows of another label whose score is `low` to `high`
    percent of the positive's. Higher scores come first, then smaller ids.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Rows with the anchor's id are no positives of it. Rows that
    repeat an id each count; anchors that repeat id, vector and label count
    once. A negative positive_score has an empty window. Shorter vectors count
    as filled up with zeros. Without anchors the result is empty.

    Labels are compared in the tasks, so no label is gathered; anchors go out in
    rounds of at most `most`, and two passes over the table serve a round.
    """
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession, "negatives")
    labelled = lambda df: df.where(F.col("label").isNotNull()).select("id", "v", F.col("label").cast("long").alias("label"))
    table, chosen = stored(labelled(rows), shelf, pivots, sample)
    anchors = shelf.put("anchors", labelled(anchors).dropDuplicates())
    if (anchors.agg(F.max(F.size("v"))).first()[0] or 0) > chosen.dim:
        anchors = anchors.withColumn("v", F.slice("v", 1, chosen.dim))

    def visit_label(query: Query, chunk: Chunk, best: Best) -> None:
        eliminate(query, chunk, (chunk.more["label"] == query.row.label) & (chunk.ids != query.row.id), best, chosen.scores)

    def end_label(query: Query, best: Best) -> list[tuple]:
        return [(query.row.id, query.number, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]

    def end_windows(query: Query, wanted: list[Wanted]) -> list[tuple]:
        return [(query.row.id, query.number, w.place, w.row.positive_id, w.row.positive_score, i, s) for w in wanted for i, s in zip(w.best.ids.tolist(), w.best.scores.tolist(), strict=True)]

    schema = lambda names: ", ".join(f"{c} long" for c in names)
    arrow = lambda names: pa.schema([(c, pa.int64()) for c in names])
    number, out = 0, shelf.empty("found", RESULT)
    for some in rounds(anchors, most):
        found = look(spark, table, chosen, some, schema(POSITIVE_COLUMNS), arrow(POSITIVE_COLUMNS), lambda _: Best(positives), visit_label, end_label, number)
        place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("positive_score"), "positive_id"))
        of: dict[int, list[Row]] = {}
        for row in found.withColumn("place", place).where(F.col("place") <= positives).collect():  # a round's positives: at most `most` times `positives`
            of.setdefault(row.asked, []).append(row)
        start = lambda query, of=of: [Wanted(r.place, r, negatives, low, high) for r in of.get(query.number, [])]
        found = look(spark, table, chosen, some, schema(COLUMNS), arrow(COLUMNS), start, lambda q, c, w: visit_windows(q, c, w, chosen.scores), end_windows, number)
        rank = F.row_number().over(Window.partitionBy("asked", "place").orderBy(F.desc("negative_score"), "negative_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
        out = shelf.add("found", found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        number += len(some)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 50, after every seventh label was made wrong; hard_negatives says what holds for odd rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(read(spark, sf_dir, "embeddings"), SCALE, label=label)
    return hard_negatives(rows, rows.where(F.col("id") % 50 == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
