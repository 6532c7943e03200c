"""Exact search for the highest inner products by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, read
from .pivots import PIVOTS, ROUND, SAMPLE, Best, Pivots, Query, eliminate, look, rounds, stored, whole_vectors

SCALE = 1024
K = 10

COLUMNS = ["query_id", "asked", "vec_id", "score"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)
ARROW = pa.schema([(c, pa.int64()) for c in COLUMNS])


def floor_from_pivots(pivots: Pivots, query: Query, k: int) -> int | None:
    """Pivots are stored rows, so k rows reach the k-th of their scores."""
    scores = pivots.scores(pivots.points[pivots.ids != query.row.id], query.q) if len(pivots.ids) else np.zeros(0)
    return int(np.sort(scores)[-k]) if len(scores) >= k else None


def top_k(rows: DataFrame, asked: DataFrame, k: int = K, pivots: int = PIVOTS, sample: int = SAMPLE, most: int = ROUND) -> DataFrame:
    """For each query the k rows with the highest inner products: query_id, rank (from 1), vec_id, score.

    Both tables come from `whole_vectors` (id, v; other columns are not used).
    Rows with the query's own id are no candidates; ties go to the smaller id.
    Rows that repeat an id each count. Queries that repeat both id and vector
    count once; those with one id and several vectors are several queries.
    Shorter vectors count as filled up with zeros. Scores beyond a long stop at
    its ends. Without queries or candidates the result is empty.

    Queries go to the tasks in rounds of at most `most`, which bounds what is
    broadcast; each round reads the whole pivot table once, and a task keeps k
    rows for each query of the round.
    """
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession, "topk")
    table, chosen = stored(rows.select("id", "v"), shelf, pivots, sample)
    asked = shelf.put("asked", asked.select("id", "v").dropDuplicates())
    dim = asked.agg(F.max(F.size("v"))).first()[0] or 1
    if dim > chosen.dim:  # a query's further components meet zeros
        asked = asked.withColumn("v", F.slice("v", 1, chosen.dim))

    def start(query: Query) -> Best:
        return Best(k, floor_from_pivots(chosen, query, k))

    def visit(query: Query, chunk, best: Best) -> None:
        eliminate(query, chunk, chunk.ids != query.row.id, best, chosen.scores)

    def end(query: Query, best: Best) -> list[tuple]:
        return [(query.row.id, query.number, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)]

    first = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    number, out = 0, shelf.empty("found", "query_id long, rank int, vec_id long, score long")
    for some in rounds(asked, most):
        found = look(spark, table, chosen, some, SCHEMA, ARROW, start, visit, end, number)
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        out = shelf.add("found", found.select("query_id", "rank", "vec_id", "score"))
        number += len(some)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of each vector whose id is divisible by 100; whole_vectors and top_k say what holds for odd rows."""
    rows = whole_vectors(read(spark, sf_dir, "embeddings"), SCALE)
    return top_k(rows, rows.where(F.col("id") % 100 == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
